"""Tables in and out: registered files, stage tables with fixed schemas, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "binary": "path string, modificationTime timestamp, length long, content binary",
    "words": "doc_key string, page_num int, page_width double, word_idx int, top double, x0 double, text string",
    "pages": "doc_key string, page_num int, text string",
    "sentences": "doc_key string, sent_idx int, sentence string",
    "vectors": "doc_key string, sent_idx int, sentence string, embedding array<float>, pooling string, model_name string",
    "questions": "question_id long, doc_key string, question string, embedding array<float>",
}


def file_rows(files: DataFrame) -> DataFrame:
    """``files(doc_key, stem, path, content)`` of rows that Spark read as binary files."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.substring(F.regexp_replace(name, r"\.[^.]*$", ""), 1, 40)
    return files.select(F.md5("content").alias("doc_key"), F.coalesce(F.nullif(stem, F.lit("")), F.lit("paper")).alias("stem"), "path", "content")


def register_files(spark: SparkSession, path: str) -> DataFrame:
    """``files(doc_key, stem, path, content)``: the key is the content's MD5, the stem the name without its extension, 40 characters at most."""
    return file_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def dedupe_documents(files: DataFrame, key: str = "doc_key", order: str = "path") -> DataFrame:
    """One row of each key, the first by ``order``. Only keys and orders are ranked; contents are joined back by both."""
    first = files.groupBy(key).agg(F.min(order).alias(order))
    return files.join(first, [key, order], "left_semi").dropDuplicates([key])


def new_documents_only(files: DataFrame, done: DataFrame, key: str = "doc_key") -> DataFrame:
    return files.join(done.select(key), key, "left_anti")


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stage table, read with its fixed schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def summary_report(summaries: DataFrame, layer: str = "Extractive") -> DataFrame:
    """``(doc_key, mode, file_name, report)`` of ``summaries``, which may have a ``stem``."""
    stem = F.col("stem") if "stem" in summaries.columns else F.lit("paper")
    prose = F.array_join("sentences", " ")
    lines = [
        F.concat(F.lit(f"{layer} summary"), F.lit("")),
        F.concat(F.lit("mode: "), "mode"),
        F.concat(F.lit("sentences: "), F.size("sentences").cast("string"), F.lit(" of "), F.col("n_total_sentences").cast("string")),
        F.concat(F.lit("words: "), F.col("word_count").cast("string")),
        F.concat(F.lit("rate: "), F.rint(F.col("compression_ratio") * 100).cast("int").cast("string"), F.lit("%")),
        F.lit("-" * 40),
        prose,
    ]
    return summaries.select("doc_key", "mode", F.concat(stem, F.lit("_"), "mode", F.lit(f"_{layer.lower()}_summary.txt")).alias("file_name"), F.concat_ws("\n", *lines).alias("report"))


def write_summaries(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Summaries or reports in a folder for each mode. As ``text``, the reports only: of summaries those that ``summary_report`` makes, a blank line after each."""
    if fmt == "text":
        reports = df if "report" in df.columns else summary_report(df)
        df = reports.select("mode", F.concat("report", F.lit("\n")).alias("value"))
    df.write.mode("overwrite").partitionBy("mode").format(fmt).save(path)
