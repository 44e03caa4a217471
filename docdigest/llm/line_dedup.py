"""Lines that documents share, kept once: an index of exact counts behind sharded cuckoo filters, to which documents can be added and from which they can be taken."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docdigest.llm.common import cut, lean
from docdigest.llm.cuckoo import CuckooFilter

#: Code points of the shortest key that counts.
MIN_CHARS = 10
#: Repeated keys of one filter when filters are made, tasks that look lines up in one filter, keys that a task counts before it hands them on.
SHARD_KEYS, SALTS, HELD_KEYS = 100_000, 8, 200_000
#: The id that a document without an id has in the index; it comes after all others.
NO_ID = (1 << 63) - 1

_BLANK = b" \t\n\x0b\x0c\r"


def _digest(line: bytes) -> bytes | None:
    """128 bits of the line's key; None if it is too short."""
    key = line.strip(_BLANK)
    if len(key) < MIN_CHARS or not key.isascii() and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _keys(text: str | None) -> dict[bytes, None]:
    """Distinct digests of a text's lines."""
    out = dict.fromkeys(map(_digest, (text or "").encode("utf-8", "replace").split(b"\n")))
    out.pop(None, None)
    return out


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


@lean
def _refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, digests = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = _keys(text)
            docs += [doc] * len(found)
            digests += found
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(digests, pa.binary())], ["doc", "digest"])


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list[int]] = {}

    def rows():
        n, first = zip(*held.values(), strict=True) if held else ((), ())
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], ["digest", "n", "first"])
        held.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for key in _keys(text):
                if (known := held.get(key)) is None:
                    held[key] = [1, doc]
                else:
                    known[0] += 1
                    known[1] = min(known[1], doc)
            if len(held) > HELD_KEYS:
                yield rows()
    yield rows()


def _values(digests: pa.Array) -> np.ndarray:
    """64 bits of each digest, for a filter."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64)[::2]


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one shard, the first column."""
    shard = batch.column(0).to_numpy()
    start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else ()
    for a, b in zip(start, [*start[1:], len(shard)] if len(shard) else (), strict=True):
        yield int(shard[a]), batch.slice(a, b - a)


@lean
def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shard, digest, sign, filter) in order, a shard's filter first: each shard's filter after its digests came (sign 1) or went (-1).

    A shard without a filter gets one with twice the room it needs. A task holds one filter and the digests of one shard, of which there are few.
    """
    at, kept, come, gone = None, None, [], []

    def made():
        f = CuckooFilter.sized(2 * max(sum(map(len, come)), 16)) if kept is None else kept
        for values, act in ((gone, f.delete), (come, f.insert)):
            if values:
                act(np.concatenate(values))
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([f.room], pa.int64()), pa.array([f.to_bytes()], pa.binary())], ["shard", "room", "filter"])

    for batch in batches:
        for shard, part in _shards(batch):
            if shard != at:
                if at is not None:
                    yield made()
                at, kept, come, gone = shard, None, [], []
            old = part.column(3).drop_null()
            if len(old):
                kept = CuckooFilter.from_bytes(old[0].as_py())
            sign = part.column(2).to_numpy()
            values = part.column(1)
            for want, into in ((1, come), (-1, gone)):
                if (sign == want).any():
                    into.append(_values(values.filter(pa.array(sign == want))))
    if at is not None:
        yield made()


@lean
def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shard, salt, digest, doc, filter) in order, a shard's filter first, the (digest, doc) that the filter may hold."""
    at, held = None, None
    for batch in batches:
        for shard, part in _shards(batch):
            if shard != at:
                at, held = shard, None
            made = part.column(4).drop_null()
            if len(made):
                held = CuckooFilter.from_bytes(made[0].as_py())
            part = part.filter(part.column(2).is_valid())
            if held is not None and part.num_rows:
                found = pa.array(held.contains(_values(part.column(2))))
                yield pa.RecordBatch.from_arrays([part.column(2).filter(found), part.column(3).filter(found)], ["digest", "doc"])


@dataclass(frozen=True)
class LineIndex:
    """What is known of the lines of some documents.

    ``references(doc, digest)`` are the keys of each document row, ``counts(digest, n, first)`` how many rows refer to a key and the
    smallest document among them, both exact; ``filters(shard, room, filter)`` hold the keys that at least two rows refer to, by shards
    of their digest. A key enters its filter when its count reaches 2 and leaves it when the count falls below, so that a line
    which its filter does not know stays without a look at the counts.
    """

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession) -> LineIndex:
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(none("doc long, digest binary"), none("digest binary, n long, first long"), none("shard int, room long, filter binary"), 0)

    def _shard(self, shards: int) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")

    def _changed(self, references: DataFrame, counts: DataFrame) -> LineIndex:
        """The index after the counts changed; ``counts`` has the old ones too, as ``was``."""
        counts = cut(counts)
        after = counts.where("n > 0").select("digest", "n", "first")
        repeated = counts.where("n >= 2")
        shards = max(self.shards, 1)
        size = repeated.groupBy(self._shard(shards)).agg(F.count("*").alias("size"))
        if not self.shards or not size.join(self.filters, "shard").where("size > room").isEmpty():  # made anew from the counts
            shards = repeated.count() // SHARD_KEYS + 1
            rows, old = repeated.select(self._shard(shards), "digest", F.lit(1).alias("sign")), None
        else:
            sign = F.when(F.col("n") >= 2, 1).otherwise(-1)
            rows = counts.where("(n >= 2) != (was >= 2)").select(self._shard(shards), "digest", sign.alias("sign"))
            old = self.filters.select("shard", F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("sign"), "filter")
        rows = rows.withColumn("filter", F.lit(None).cast("binary"))
        rows = rows if old is None else rows.union(old)
        filters = rows.repartition("shard").sortWithinPartitions("shard", "digest").mapInArrow(_filters, "shard int, room long, filter binary")
        return LineIndex(references, after, cut(filters), shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents added. Each task counts its own keys, so a key of a third of all lines arrives as a row for each task."""
        rows = _documents(docs)
        new = rows.mapInArrow(_count, "digest binary, n long, first long").withColumn("was", F.lit(0).cast("long"))
        both = self.counts.select("digest", "n", "first", F.col("n").alias("was")).union(new)
        counts = both.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("was").alias("was"))
        return self._changed(self.references.union(rows.mapInArrow(_refer, "doc long, digest binary")), counts)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of these ``doc_id``: as if they had never been inserted. Where a key's smallest document goes, the next is found among the references that are left."""
        ids = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        left = self.references.join(ids, "doc", "left_anti")
        gone = cut(self.references.join(ids, "doc", "left_semi").groupBy("digest").agg(F.count("*").alias("gone"), F.min("doc").alias("least")))
        counts = self.counts.join(gone, "digest", "left")
        headless = counts.where("least = first and gone < n").select("digest")
        heads = left.join(headless, "digest", "left_semi").groupBy("digest").agg(F.min("doc").alias("head"))
        counts = counts.join(heads, "digest", "left").select("digest", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"), F.coalesce("head", "first").alias("first"), F.col("n").alias("was"))
        return self._changed(left, counts)

    def repeats(self, references: DataFrame | None = None) -> DataFrame:
        """``(doc, digest)`` of the keys that a document has to give up because a smaller one holds them. References go to their shard's filter in several parts; only what it may hold meets the counts."""
        none = lambda kind: F.lit(None).cast(kind)
        rows = (self.references if references is None else references).select(self._shard(max(self.shards, 1)), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"), "digest", "doc", none("binary").alias("filter"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        held = self.filters.select("shard", salts, "filter").select("shard", "salt", none("binary").alias("digest"), none("long").alias("doc"), "filter")
        both = rows.union(held).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("doc").asc_nulls_first())
        maybe = both.mapInArrow(_screen, "digest binary, doc long")
        return maybe.join(self.counts.where("n >= 2").select("digest", "first"), "digest").where("doc != first").select("doc", "digest")

    def apply(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_lines, n_dropped, text)`` of documents that are in the index: their lines but for those that smaller documents hold."""
        rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
        out = self.repeats(_documents(docs).mapInArrow(_refer, "doc long, digest binary")).groupBy("doc").agg(F.collect_set("digest").alias("gone"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        return rows.join(out, "doc", "left").select("doc_id", "text", "gone").mapInArrow(_drop, f"doc_id {kind}, n_lines long, n_dropped long, text string")

    def save(self, path: str) -> None:
        """All tables as Parquet, in folders under ``path``."""
        for name in ("references", "counts", "filters"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.counts.sparkSession.range(1).select(F.lit(self.shards).alias("shards")).write.mode("overwrite").parquet(f"{path}/shape")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        references, counts, filters, shape = (spark.read.parquet(f"{path}/{name}") for name in ("references", "counts", "filters", "shape"))
        return cls(references, counts, filters, shape.first().shards)


@lean
def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, dropped, texts = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = text.encode("utf-8", "replace").split(b"\n")
            gone = set(gone or ())
            left = [line for line in lines if _digest(line) not in gone] if gone else lines
            total.append(len(lines))
            dropped.append(len(lines) - len(left))
            texts.append(b"\n".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)``: lines whose key several documents have stay in the smallest of them only.

    A key is the line without blanks at its ends, A-Z lower-cased, of ten code points at least. A null or empty text is one empty line. Rows of
    one ``doc_id`` are one document, all rows without an id another, which comes last; each row has its own result. Other columns are not read.
    """
    return LineIndex.empty(docs.sparkSession).insert(docs).apply(docs)
