"""Documents and questions that arrive over time. Each micro-batch runs the batch code.

A sink has rows in folders by ``batch`` and, inside, by ``part``, a hash of the key: a replayed batch writes its own folder again, and
only the parts that a batch touches are read. Every so many batches, all before the last are folded into a snapshot by part;
a manifest names the snapshot once it is whole. So a batch reads one snapshot and the few batches after it, however many there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docdigest.operators.pages import ingest_documents
from docdigest.operators.retrieve import retrieve_topk
from docdigest.sources.tables import SCHEMAS, file_rows

#: Parts of a sink, and batches after a snapshot that are read one by one.
PARTS, TAIL = 64, 16
#: Folders beside the batches; names that start so are no data to Spark.
SNAPSHOTS, MANIFEST = "_snapshots", "_manifest"

MATCHES = "question_id long, doc_key string, rank int, sent_idx int, sentence string, score double"
FILES = "doc_key string, stem string, path string"
DOCS = "doc_key string, joined_text string, cleaned_text string, abstract string"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """Numbers in the names of a folder's entries, ascending."""
    fs, place = _folder(spark, path)
    if not fs.exists(place):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(place)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())


def _with_part(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """Rows of a sink with their ``batch`` and ``part``: the last snapshot and the batches after it; none if there is no sink yet. Batches from ``before`` on do not count."""
    whole = f"{schema}, batch long, part int"
    last = max(_numbers(spark, f"{path}/{MANIFEST}"), default=None)
    if last is not None and before is not None and last >= before:
        raise ValueError(f"batches up to {last} are folded; there is no state before {before}")
    tail = [b for b in _numbers(spark, path, "batch=") if (last is None or b > last) and (before is None or b < before)]
    reads = [spark.read.schema(whole).parquet(f"{path}/{SNAPSHOTS}/{last}")] if last is not None else []
    if tail:
        reads.append(spark.read.schema(whole).option("basePath", path).parquet(*(f"{path}/batch={b}" for b in tail)))
    if not reads:
        return spark.createDataFrame([], whole)
    rows = reads[0] if len(reads) == 1 else reads[0].unionByName(reads[1])
    return rows if parts is None else rows.where(F.col("part").isin(parts))


def _write(df: DataFrame, path: str, key: str, batch: int) -> None:
    _with_part(df, key).write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={batch}")


def fold(spark: SparkSession, path: str, schema: str, upto: int) -> None:
    """All batches up to ``upto`` as one snapshot, a few files for each part.

    The manifest gets its name only when the snapshot is written; a crash before that leaves the sink as it was, and the next fold writes the
    snapshot again. What the snapshot before this one held on its own is deleted then, so that whoever still reads that one can.
    """
    rows = stored(spark, path, schema, upto + 1)
    before = _numbers(spark, f"{path}/{MANIFEST}")
    rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/{SNAPSHOTS}/{upto}")
    fs, place = _folder(spark, f"{path}/{MANIFEST}/{upto}")
    fs.mkdirs(place)
    if before:
        old = [f"{path}/batch={b}" for b in _numbers(spark, path, "batch=") if b <= before[-1]]
        old += [f"{path}/{SNAPSHOTS}/{s}" for s in _numbers(spark, f"{path}/{SNAPSHOTS}") if s < before[-1]]
        for name in [*old, *(f"{path}/{MANIFEST}/{s}" for s in before[:-1])]:
            fs.delete(_folder(spark, name)[1], True)


def _settle(spark: SparkSession, path: str, schema: str, batch: int) -> None:
    """Folds what is before this batch (which may be replayed) if that is much."""
    last = max(_numbers(spark, f"{path}/{MANIFEST}"), default=-1)
    if batch - 1 - last >= TAIL:
        fold(spark, path, schema, batch - 1)


def _parts(df: DataFrame, key: str) -> list[int]:
    return [r.part for r in _with_part(df, key).select("part").distinct().collect()]


def current(spark: SparkSession, path: str, key: str = "doc_key", schema: str = DOCS) -> DataFrame:
    """The newest row of each key of a sink of ``schema``."""
    rows = stored(spark, path, schema)
    newest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [key, "batch"], "left_semi").drop("part", "batch")


def _start(stream: DataFrame, each, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_files(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Files of any kind that arrive in a folder, registered once for each content: ``(doc_key, stem, path)``, of equal contents the first path that was seen."""

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("doc_key").agg(F.min(F.struct("path", "stem")).alias("f")).select("doc_key", "f.stem", "f.path").persist()
        done = stored(batch.sparkSession, sink, FILES, number, _parts(fresh, "doc_key"))
        _write(fresh.join(done, "doc_key", "left_anti"), sink, "doc_key", number)
        _settle(batch.sparkSession, sink, FILES, number)
        fresh.unpersist()

    files = spark.readStream.format("binaryFile").schema(SCHEMAS["binary"]).option("recursiveFileLookup", "true").load(source)
    return _start(file_rows(files).select("doc_key", "stem", "path"), each, checkpoint)


def stream_ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, min_page_chars: int = 100) -> StreamingQuery:
    """Pages that arrive as Parquet become cleaned documents: ``sink/pages`` has each page once, ``sink/docs`` a document again whenever it gets pages.

    Of pages of one number, the first that arrived counts, inside a batch the least text. ``current`` gives each document as it is now.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("doc_key", "page_num").agg(F.min("text").alias("text")).persist()
        parts = _parts(fresh, "doc_key")
        before = stored(batch.sparkSession, f"{sink}/pages", SCHEMAS["pages"], number, parts)
        new = fresh.join(before, ["doc_key", "page_num"], "left_anti").select(fresh.columns)
        _write(new, f"{sink}/pages", "doc_key", number)
        known = stored(batch.sparkSession, f"{sink}/pages", SCHEMAS["pages"], number + 1, parts)
        touched = known.where(F.col("batch") == number).select("doc_key").distinct()
        pages = known.join(touched, "doc_key", "left_semi").select("doc_key", "page_num", "text")
        _write(ingest_documents(pages, min_page_chars)[0], f"{sink}/docs", "doc_key", number)
        _settle(batch.sparkSession, f"{sink}/pages", SCHEMAS["pages"], number)
        _settle(batch.sparkSession, f"{sink}/docs", DOCS, number)
        fresh.unpersist()

    return _start(spark.readStream.schema(SCHEMAS["pages"]).parquet(source), each, checkpoint)


def stream_retrieve(spark: SparkSession, source: str, vectors: DataFrame, sink: str, checkpoint: str, k: int = 3) -> StreamingQuery:
    """Questions that arrive as Parquet get the k best sentences of their documents, each question id once; of several questions of an id in a batch, the least text."""

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("question_id").agg(F.min(F.struct("question", "doc_key", "embedding")).alias("q")).select("question_id", "q.*").persist()
        done = stored(batch.sparkSession, sink, MATCHES, number, _parts(fresh, "question_id")).select("question_id").distinct()
        _write(retrieve_topk(fresh.join(done, "question_id", "left_anti"), vectors, k), sink, "question_id", number)
        _settle(batch.sparkSession, sink, MATCHES, number)
        fresh.unpersist()

    return _start(spark.readStream.schema(SCHEMAS["questions"]).parquet(source), each, checkpoint)
