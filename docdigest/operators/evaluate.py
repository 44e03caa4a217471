"""ROUGE of summaries against abstracts."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from docdigest.functions.stem import porter_stem
from docdigest.operators.kernels import lcs_length


def rouge_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


@F.pandas_udf(ArrayType(StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """Porter stems of tokens of more than three characters; each distinct token of a batch is stemmed once."""
    stems: dict[str, str] = {}
    for row in tokens:
        for t in row if row is not None else ():
            if t not in stems:
                stems[t] = porter_stem(t) if len(t) > 3 else t
    return tokens.map(lambda row: None if row is None else [stems[t] for t in row])


def rouge_n(pairs: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """``(*keys, rougeN)`` of ``pairs(*keys, summary, reference)``: F1 of the n-grams of two token arrays, each counted as often as both sides have it.

    Null without a reference, 0 without n-grams in common. ``keys`` must tell the rows apart. N-grams are counted by key, so a long
    text is no more than its rows.
    """
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)) - (n - 1))
    at = lambda c: F.when(size(c) > 0, F.sequence(F.lit(1), size(c))).otherwise(F.array().cast("array<int>"))
    grams = lambda c: F.transform(at(c), lambda i: F.array_join(F.slice(c, i, n), " "))
    side = lambda c, a, b: pairs.select(*keys, F.explode(grams(F.col(c))).alias("gram"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counted = side("summary", 1, 0).union(side("reference", 0, 1)).groupBy(*keys, "gram").agg(F.least(F.sum("a"), F.sum("b")).alias("both"))
    shared = counted.groupBy(*keys).agg(F.sum("both").alias("both"))
    sizes = pairs.select(*keys, (F.coalesce(F.size("reference"), F.lit(0)) > 0).alias("known"), (size(F.col("summary")) + size(F.col("reference"))).alias("n"))
    both = F.coalesce("both", F.lit(0))
    score = F.when(F.col("known"), F.when(both == 0, 0.0).otherwise(2 * both / F.col("n")))
    return sizes.join(shared, keys, "left").select(*keys, score.alias(f"rouge{n}"))


def _f1(x, y, n: int) -> float | None:
    """F1 of the n-grams of two token arrays; null without a reference."""
    if y is None or not len(y):
        return None
    a, b = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in ((() if x is None else x), y))
    both = (a & b).total()
    return 2 * both / (a.total() + b.total()) if both else 0.0


def _lcs_f1(x, y) -> float | None:
    if x is None or y is None or not len(y):
        return None
    n = lcs_length(list(x), list(y)) if len(x) else 0
    return 2 * n / (len(x) + len(y)) if n else 0.0


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays; null without a reference."""
    return pd.Series([_lcs_f1(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("rouge1", "rouge2", "rougeL")]))
def rouge_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All three scores of two token arrays, which a task holds anyway: no n-gram is shuffled."""
    rows = [(_f1(x, y, 1), _f1(x, y, 2), _lcs_f1(x, y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"], dtype=object)


def rouge(summaries: DataFrame, docs: DataFrame, stem: bool = True) -> DataFrame:
    """``rouge(doc_key, mode, rouge1, rouge2, rougeL)`` of summaries against their documents' abstracts; nulls without an abstract."""
    shape = (lambda c: stemmed(rouge_tokens(c))) if stem else rouge_tokens
    keys = ["doc_key", "mode"]
    pairs = summaries.select(*keys, shape(F.array_join("sentences", " ")).alias("summary")).join(docs.select("doc_key", shape(F.coalesce("abstract", F.lit(""))).alias("reference")), "doc_key", "left")
    return pairs.select(*keys, rouge_scores("summary", "reference").alias("r")).select(*keys, "r.*")
