"""Helpers that the operators share: lineage cuts, word and shingle hashing on byte arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts can be long, so batches hold few rows.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Make Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Give memory that is free inside this worker back to the system, for the JVM and the worker's neighbours."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(work):
    """A function from batches to batches that gives free memory back when its task ends. Workers outlive their tasks."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, so that lost executors never force a recomputation of all before it.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one and
    any other is refused, because executors do not share local folders.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="docdigest-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage between the steps of a long operator: only then does Spark delete shuffle files and checkpoints of tables that nobody refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that was cut and is read no more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD" and (rdd := plan.rdd()).getCheckpointFile().isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a narrow table that may be broadcast, and bytes of its strings: about 20 MB at most.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def small(df: DataFrame, *strings: str) -> DataFrame:
    """A narrow table that was cut, marked for broadcast if it has few rows and short ``strings``; else as it is, and the join shuffles."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(0)).cast("long")
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: all of ASCII but 0-9 and a-z.
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[:128] = True
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiplications, three shifts)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * out[done - 1 : done] * np.uint64(_ODD)
        done += m
    return out


_POWERS = _powers(1 << 12)


def word_bounds(data: bytes, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and where each word starts and ends."""
    a = np.frombuffer(data, np.uint8)
    gap = np.ones(len(a) + 2, np.int8)
    gap[1:-1] = (_NOT_ALNUM if alnum else _SPACE)[a]
    step = np.diff(gap)
    return a, np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_hashes(data: bytes, alnum: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order. Words are runs of non-space bytes, or of ASCII letters, digits and non-ASCII bytes."""
    global _POWERS
    a, start, end = word_bounds(data, alnum)
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    if (longest := int(size.max())) > len(_POWERS):
        _POWERS = _powers(longest)
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(first, size)
    values = (a[np.repeat(start, size) + inside].astype(np.uint64) + np.uint64(1)) * _POWERS[inside]
    return mix64(np.add.reduceat(values, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(data: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles of a lower-cased text; with fewer words, of the whole sequence."""
    h = word_hashes(data.lower())
    if not len(h):
        return h
    k = min(words, len(h))
    m = len(h) - k + 1
    x = np.full(m, np.uint64(k))
    for i in range(k):
        x = mix64(x * np.uint64(0x2545F4914F6CDD1D) + h[i : i + m])
    return np.unique(x)
