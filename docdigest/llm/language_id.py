"""Language identification with hyperdimensional letter profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docdigest.llm.common import cut, lean

#: Dimensions of a hypervector, and the seed of the letters' random vectors.
DIM, SEED = 1024, 20_261
#: Letter symbols: 0 stands for whatever is no letter, 1-26 for a-z, 27-59 for U+00DF-U+00FF, the rest shares 67 buckets.
SYMBOLS = 128
#: Texts and code points that are profiled together, and distinct n-grams of one matrix product.
TEXTS, CHARS, GRAMS = 256, 1 << 20, 8192
#: Languages whose prototypes go to every task at once, and whose sums a task holds.
LANGUAGES = 1000


def _symbol(cp: int) -> int:
    if not chr(cp).isalpha():
        return 0
    if 97 <= cp <= 122:
        return cp - 96
    return 27 + cp - 0xDF if 0xDF <= cp <= 0xFF else 60 + cp % 67


_TABLE = np.array([_symbol(cp) for cp in range(1 << 16)], np.uint8)


def _symbols(text: str) -> np.ndarray:
    """A symbol for each code point of the lower-cased text, in pieces so that a very long text needs little memory."""
    text = text.lower()
    out = []
    for at in range(0, len(text), CHARS):
        cp = np.frombuffer(text[at : at + CHARS].encode("utf-32-le", "replace"), np.uint32)
        s = _TABLE[cp & 0xFFFF]
        if len(cp) and cp.max() > 0xFFFF:
            high = cp > 0xFFFF
            s[high] = [_symbol(int(c)) for c in cp[high]]
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


class Profiler:
    """Bundles of bound trigrams: the vector of the letters ``abc`` is rho(rho(a)) * rho(b) * c, rho a rotation by one."""

    def __init__(self, dim: int = DIM, seed: int = SEED) -> None:
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dim))
        self.dim, self.at = dim, [np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters]
        self.row = np.zeros(SYMBOLS**3, np.int32)

    def bundle(self, texts: list[str], groups: list[int], n: int) -> np.ndarray:
        """An (n, dim) matrix: row g is the sum of the trigram vectors of all texts whose group is g."""
        symbols = [_symbols(x) for x in texts]
        out = np.zeros((n, self.dim))
        gap = np.zeros(1, np.uint8)
        s = np.concatenate([gap, *(y for x in symbols for y in (x, gap))])
        owner = np.repeat(np.array(groups, np.int32), [len(x) + 1 for x in symbols])
        owner = np.concatenate([owner[:1], owner])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s, owner = s[keep], owner[keep]
        for at in range(0, max(0, len(s) - 2), 4 * CHARS):
            x = s[at : at + 4 * CHARS + 2].astype(np.int32)
            inner = x[1:-1] != 0
            gram = ((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:])[inner]
            who = owner[at + 1 : at + 1 + len(inner)][inner]
            seen = np.zeros(SYMBOLS**3, bool)
            seen[gram] = True
            ids = np.flatnonzero(seen)
            self.row[ids] = np.arange(len(ids))
            row = self.row[gram]
            for lo in range(0, len(ids), GRAMS):
                part = ids[lo : lo + GRAMS]
                of = (row >= lo) & (row < lo + len(part)) if len(ids) > GRAMS else slice(None)
                counts = np.bincount(who[of].astype(np.int64) * len(part) + row[of] - lo, minlength=n * len(part)).reshape(n, -1)
                vectors = self.at[0][part // SYMBOLS**2] * self.at[1][part // SYMBOLS % SYMBOLS] * self.at[2][part % SYMBOLS]
                out += counts.astype(np.float32) @ vectors
        return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are profiled together."""
    start = chars = 0
    for i, x in enumerate(texts):
        if i > start and (i - start == TEXTS or chars + len(x) > CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(x)
    if start < len(texts):
        yield start, len(texts)


def fit_prototypes(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``(lang, vector)``: one bundle for each language of ``docs(text, lang)``, over all rows where neither is null.

    Each task sums its rows; only these sums shuffle.
    """

    @lean
    def sums(batches):
        profiler, total = Profiler(dim, seed), {}

        def rows():
            for name, row in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(range(dim), pa.int32()), pa.array(row)], ["lang", "d", "v"])

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            at = {x: i for i, x in enumerate(names)}
            for lo, hi in _slices(texts):
                own = sorted({at[x] for x in langs[lo:hi]})
                for g, row in zip(own, profiler.bundle(texts[lo:hi], [own.index(at[x]) for x in langs[lo:hi]], len(own)), strict=True):
                    total[names[g]] = total.get(names[g], 0) + row
                if len(total) > LANGUAGES:
                    yield from rows()
                    total.clear()
        yield from rows()

    learned = docs.select("text", "lang").where("text is not null and lang is not null")
    summed = learned.mapInArrow(sums, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    vectors = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("vector"))
    return cut(vectors)


def _blocks(prototypes: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages in order of their names, and their unit vectors as rows, in blocks of bounded size; none of them empty."""
    names, rows = [], []
    for r in prototypes.orderBy("lang").toLocalIterator():
        names.append(r.lang)
        rows.append(np.array(r.vector))
        if len(names) == LANGUAGES:
            yield names, np.stack(rows)
            names, rows = [], []
    if names:
        yield names, np.stack(rows)


_BEST = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def _best(names: list[str], matrix: np.ndarray, dim: int, seed: int):
    """Of rows (text, row) or (text, row, best so far): the row, and the prototype of the largest cosine with its cosine, if the text has letters."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms == 0, 1, norms)

    @lean
    def predict(batches):
        profiler = Profiler(dim, seed)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            before = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            lang, score = [], []
            for lo, hi in _slices(texts):
                v = profiler.bundle(texts[lo:hi], list(range(hi - lo)), hi - lo)
                size = np.linalg.norm(v, axis=1)
                cos = v @ matrix.T / np.where(size == 0, 1, size)[:, None]
                for i, (k, n, old) in enumerate(zip(cos.argmax(1).tolist(), size.tolist(), before[lo:hi], strict=True)):
                    own = min(1.0, max(0.0, float(cos[i, k])))
                    better = n > 0 and (old is None or old["lang_pred"] is None or own > old["score"])
                    lang.append(names[k] if better else old and old["lang_pred"])
                    score.append(own if better else old and old["score"])
            best = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], _BEST.names)
            yield pa.RecordBatch.from_arrays([batch.column(1), best], ["row", "best"])

    return predict


def _predicted(docs: DataFrame, prototypes: DataFrame, dim: int, seed: int) -> DataFrame:
    """``(row, best)``: the rows of ``docs`` and what was predicted. Rows are structs, so that names cannot clash."""
    out = docs.select("text", F.struct("*").alias("row"))
    schema = StructType([StructField("row", docs.schema), StructField("best", _BEST)])
    for names, matrix in _blocks(prototypes):
        if "best" in out.columns:
            out = out.select(F.col("row.text").alias("text"), "row", "best")
        out = out.mapInArrow(_best(names, matrix, dim, seed), schema)
    return out if "best" in out.columns else out.select("row", F.lit(None).cast(_BEST).alias("best"))


def predict_language(docs: DataFrame, prototypes: DataFrame, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the prototype of the largest cosine with the text's bundle, and that cosine; of equals, the first by name.

    A null text, one without letters, and any text when nothing was learned get ``und`` and 0. Columns of these names that
    ``docs`` had are replaced. Whole texts are profiled, in pieces of bounded memory; there is no shuffle. Prototypes go to every
    task, in blocks of ``LANGUAGES``: more take one pass for each block.
    """
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in _BEST.names]
    best = F.col("best")
    return _predicted(docs, prototypes, dim, seed).select(*rest, F.coalesce(best["lang_pred"], F.lit("und")).alias("lang_pred"), F.coalesce(best["score"], F.lit(0.0)).alias("score"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is left out of learning: crc32 of its id, as text, is divisible by 5. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: str = "doc_id"):
    """Whether a document may be learned from; a null id may not."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def keep_known(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The documents whose language is known, with all their columns as they were: those with letters, whose score is ``min_score`` at least."""
    prototypes = fit_prototypes(docs.where(learnable()).select("text", "lang"))
    return _predicted(docs, prototypes, DIM, SEED).where(F.col("best.lang_pred").isNotNull() & (F.col("best.score") >= min_score)).select("row.*")
