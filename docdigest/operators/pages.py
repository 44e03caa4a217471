"""From positioned words to pages, documents and sentences."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdigest.functions.text import clean_text, extract_abstract, kept_array, quality_verdict, split_sentences

# A word with its inner periods and the one after it, between opening and closing marks; white space ends it.
TOKEN, WORD_AND_PERIOD = r"[^\t\n\x0B\f\r ]+", r"""^["'(\[]*(\p{L}[\p{L}.]*?)(\.?)["')\],;:!?]*$"""
#: Score from which a word is an abbreviation, and the chance of a period after one.
ABBREVIATION_SCORE, PERIOD_CHANCE = 0.3, 0.99
#: Abbreviations that one pattern of the splitter holds, the best of those learned.
MOST_ABBREVIATIONS = 2000


def assemble_pages(words: DataFrame, detect_columns: bool = True) -> DataFrame:
    """``pages(doc_key, page_num, text)``: words by line (tops within 4 points; 5 without columns) and position, the left half of the page first."""
    step = 4 if detect_columns else 5
    item = F.struct((F.rint(F.col("top") / step) * step).alias("line"), "x0", "word_idx", "text")

    def joined(side):
        return F.array_join(F.transform(F.sort_array(F.collect_list(side)), lambda x: x["text"]), " ")

    left = F.col("x0") < F.col("page_width") / 2
    text = F.concat(joined(F.when(left, item)), F.lit(" "), joined(F.when(~left, item))) if detect_columns else joined(item)
    return words.groupBy("doc_key", "page_num").agg(text.alias("text"))


def page_length_gate(pages: DataFrame, min_chars: int = 100) -> DataFrame:
    return pages.where(F.length("text") >= min_chars)


def join_pages(pages: DataFrame, sep: str = ". ") -> DataFrame:
    """``docs(doc_key, joined_text)``: pages in their order."""
    ordered = F.sort_array(F.collect_list(F.struct("page_num", "text")))
    return pages.groupBy("doc_key").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), sep).alias("joined_text"))


def kept_sentences(docs: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """``sentences(doc_key, sent_idx, sentence)``, numbered from 0 among those kept."""
    return docs.select("doc_key", F.posexplode(kept_array(F.col(text))).alias("sent_idx", "sentence"))


def abbreviation_scores(docs: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """``(word, with_period, without_period, score)`` of every lower-cased word of the corpus: how much the period after it is a part of it.

    A log-likelihood ratio weighs periods that follow the word for their own sake (chance 0.99) against periods that follow words by their share of the corpus;
    it counts for less the longer the word is and the more often it stands without period, and for more with inner periods. One
    pass over the texts; words are counted in tasks before they shuffle, and all scores come from two counts.
    """
    token = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN})"), F.lit(1))).alias("t"))
    part = lambda i: F.regexp_extract("t", WORD_AND_PERIOD, i)
    words = token.select(F.lower(part(1)).alias("word"), (part(2) == ".").alias("period")).where("word != ''")
    counted = words.groupBy("word").agg(F.count_if("period").alias("with_period"), F.count_if(~F.col("period")).alias("without_period"))
    whole = counted.agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("without_period")).alias("words"))
    a, b, share = F.col("with_period"), F.col("without_period"), F.col("periods") / F.col("words")
    ratio = 2 * (a * (F.log(F.lit(PERIOD_CHANCE)) - F.log(share)) + b * (F.log(F.lit(1 - PERIOD_CHANCE)) - F.log(1 - share)))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    weight = F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -b)
    sure = (F.col("periods") > 0) & (F.col("periods") < F.col("words"))
    return counted.join(F.broadcast(whole)).select("word", "with_period", "without_period", F.when(sure, ratio * weight).otherwise(0.0).alias("score"))


def learn_abbreviations(docs: DataFrame, text: str = "cleaned_text", least: float = ABBREVIATION_SCORE) -> list[str]:
    """Words that the corpus shows to be abbreviations, at most ``MOST_ABBREVIATIONS``, the best first."""
    scored = abbreviation_scores(docs, text).where((F.col("score") >= least) & (F.col("with_period") > F.col("without_period")))
    return [r.word for r in scored.orderBy(F.desc("score"), "word").limit(MOST_ABBREVIATIONS).collect()]


def abbreviation_patterns(words: list[str]) -> list[str]:
    """Learned words as patterns for ``split_sentences``, in any case."""
    return [f"(?i:{re.escape(w)})" for w in words]


def quality_report(docs: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Sentences of each document by verdict; keys must tell documents apart. Sentences are rows, so that verdicts are compiled code; counts are summed in tasks before they shuffle."""
    rows = docs.select("doc_key", F.explode_outer(split_sentences(F.col(text))).alias("s")).select("doc_key", quality_verdict(F.col("s")).alias("v"), F.col("s").isNotNull().alias("said"))
    return rows.groupBy("doc_key").agg(*(F.count_if(F.col("said") & (F.col("v") == k)).alias(f"n_{k}") for k in ("short", "symbolic", "reversed", "keep")))


def document_status(docs: DataFrame, text: str = "cleaned_text", min_sentences: int = 4) -> DataFrame:
    n = F.size(kept_array(F.coalesce(F.col(text), F.lit(""))))
    return docs.select("doc_key", n.cast("long").alias("n_sentences")).withColumn("status", F.when(F.col("n_sentences") == 0, "no_text").when(F.col("n_sentences") < min_sentences, "too_few_sentences").otherwise("ok"))


def document_metrics(docs: DataFrame) -> DataFrame:
    """Characters before and after cleaning, and the share that was noise."""
    raw, clean = F.length("joined_text").cast("long"), F.length("cleaned_text").cast("long")
    return docs.select("doc_key", raw.alias("raw_chars"), clean.alias("cleaned_chars"), (raw - clean).alias("noise"), ((raw - clean) / F.greatest(raw, F.lit(1))).alias("noise_pct"))


def ingest_documents(pages: DataFrame, min_page_chars: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(docs, sentences)`` of pages: length gate, join, cascade, abstract, kept sentences."""
    docs = join_pages(page_length_gate(pages, min_page_chars)).withColumn("cleaned_text", clean_text(F.col("joined_text")))
    docs = docs.withColumn("abstract", extract_abstract(F.col("cleaned_text")))
    return docs, kept_sentences(docs)
