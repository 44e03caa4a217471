"""Substring dedup with content-defined chunks cut by a gear rolling hash."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdigest.llm.common import cut, lean, word_bounds

#: A chunk ends after a unit whose rolling hash is the smallest among so many units on each side: about 2 * REACH + 1 units.
REACH = 4
#: Units of a chunk at most.
LONGEST = 32
#: Bytes of a word from which on its code points are units, as in text without spaces. Two of them count as a word.
LONG_WORD = 48
#: Words of whole repeated chunks that start a passage, and words of a passage that counts.
SEED_WORDS, MIN_WORDS = 10, 40
#: Units that a passage grows by on each side, at most, over what its whole chunks cover.
CONTEXT = 36

_GEAR = np.random.default_rng(7_919).integers(0, 1 << 64, 256, np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """After each byte, the sum over the last 32 bytes of their gear values, each shifted left by its distance."""
    h = _GEAR[data]
    for m in (1, 2, 4, 8, 16):
        shifted = h[:-m] << np.uint64(m)
        h = h.copy()
        h[m:] += shifted
    return h


def units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, where each unit starts and ends, and twice the words it counts for: words, and code points of long words."""
    a, start, end = word_bounds(data)
    long = end - start > LONG_WORD
    if not long.any():
        return a, start, end, np.full(len(start), 2)
    edge = np.zeros(len(a) + 1, np.int8)
    edge[start[long]] += 1
    edge[end[long]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    first = inside & ((a & 0xC0) != 0x80)
    first[start] = True
    at = np.flatnonzero(first)
    of = np.searchsorted(start, at, "right") - 1
    return a, at, np.minimum(np.append(at[1:], len(a)), end[of]), np.where(long[of], 1, 2)


def chunk_ends(h: np.ndarray) -> np.ndarray:
    """Numbers of the units that end a chunk, from the rolling hash at each unit's end. Only the units in reach decide a cut."""
    n = len(h)
    low = np.ones(n, bool)
    for d in range(1, min(REACH, n - 1) + 1):
        low[d:] &= h[d:] < h[:-d]
        low[:-d] &= h[:-d] <= h[d:]
    low[-1:] = True
    ends = np.flatnonzero(low)
    gaps = np.diff(ends, prepend=-1)
    if len(gaps) and gaps.max() > LONGEST:
        extra = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends, gaps, strict=True) if g > LONGEST]
        ends = np.sort(np.concatenate([ends, *extra]))
    return ends


_CHUNKS = "doc_id long, digest long, text_id int, k int, start int, end int, halves int, again boolean"
#: Chunks that one Arrow batch has at most, about.
ROWS = 1 << 14


@lean
def _chunks(batches):
    """The chunks of rows (doc_id, text_id, text): 64-bit digest, number, code point span, twice the words, and whether the text had it before."""
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    columns: list[list[np.ndarray]] = [[] for _ in names]
    held = 0

    def rows():
        kinds = [np.int64] * 2 + [np.int32] * 5 + [bool]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(kind)) for c, kind in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for doc_id, text_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = x.as_py().encode()
            a, first, last, halves = units(data)
            if not len(first):
                continue
            points = np.cumsum((a & 0xC0) != 0x80)
            at, to = points[first] - 1, points[last - 1]
            if (spaced := b" ".join(data.split())) != data:  # white space does not count
                data = spaced
                a, first, last, _ = units(data)
            end = chunk_ends(gear(a)[last - 1])
            begin = np.append(0, end[:-1] + 1)
            lo, hi = first[begin], last[end]
            digest = np.array([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64).view(np.int64)
            again = np.ones(len(end), bool)
            again[np.unique(digest, return_index=True)[1]] = False
            n = len(end)
            row = (np.full(n, doc_id), digest, np.full(n, text_id), np.arange(n), at[begin], to[end], np.diff(np.cumsum(halves)[end], prepend=0), again)
            for c, y in zip(columns, row, strict=True):
                c.append(y)
            held += n
            if held > ROWS:
                yield rows()
                columns, held = [[] for _ in names], 0
    if held:
        yield rows()


def _contexts(batches):
    """Of rows (doc_id, text_id, asked, text): for each place (pos, side) the units before or after it, next first: hashes, code points they reach to, twice the words so far."""
    for batch in batches:
        out = []
        for doc_id, text_id, asked, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            a, first, last, halves = units(data)
            points = np.cumsum((a & 0xC0) != 0x80)
            start, end = points[first] - 1, points[last - 1]
            for x in asked:
                if x["side"] == 0:
                    n = int(np.searchsorted(end, x["pos"], "right"))
                    at, reach = np.arange(n - 1, max(-1, n - 1 - CONTEXT), -1), start
                else:
                    n = int(np.searchsorted(start, x["pos"]))
                    at, reach = np.arange(n, min(len(first), n + CONTEXT)), end
                hashes = [zlib.crc32(data[i:j]) - (1 << 31) for i, j in zip(first[at].tolist(), last[at].tolist(), strict=True)]
                out.append((doc_id, text_id, x["pos"], x["side"], hashes, reach[at].tolist(), np.cumsum(halves[at]).tolist()))
        kinds = {"doc_id": pa.int64(), "text_id": pa.int32(), "pos": pa.int32(), "side": pa.int32(), "hashes": pa.list_(pa.int32()), "reach": pa.list_(pa.int32()), "more": pa.list_(pa.int32())}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def _grown(rows: DataFrame, runs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``runs`` with spans that reach as far as their texts agree with those of the first occurrences of their outer chunks."""
    key = ["doc_id", "text_id", "run"]
    side = lambda n, pos, chunk: runs.select(*key, F.lit(n).alias("side"), F.col(pos).alias("pos"), F.col(f"{chunk}.*"))
    edges = side(0, "start", "left").union(side(1, "end", "right"))
    edges = edges.join(firsts, F.col("digest") == F.col("d"))
    edges = cut(edges.select(*key, "side", "pos", "first", F.when(F.col("side") == 0, F.col("at.start")).otherwise(F.col("at.end")).alias("first_pos")))
    asked = edges.select("doc_id", "pos", "side").union(edges.select("first", "first_pos", "side")).distinct()
    asked = asked.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("pos", "side")).alias("asked"))
    found = rows.join(asked, F.col("doc_id") == F.col("d")).select("doc_id", "text_id", "asked", "text")
    found = found.mapInArrow(lean(_contexts), "doc_id long, text_id int, pos int, side int, hashes array<int>, reach array<int>, more array<int>")
    place = ["doc_id", "text_id", "pos", "side"]
    found = cut(found.groupBy(*place).agg(*(F.first(c).alias(c) for c in ("hashes", "reach", "more"))))
    there = found.select(F.col("doc_id").alias("first"), F.col("pos").alias("first_pos"), "side", F.col("hashes").alias("others"))
    both = edges.join(found, place).join(there, ["first", "first_pos", "side"])
    n = F.least(F.size("hashes"), F.size("others"))
    same = F.zip_with(F.slice("hashes", 1, n), F.slice("others", 1, n), lambda a, b: a == b)
    at = F.array_position(same, F.lit(False)).cast("int")
    both = both.withColumn("by", F.when(at == 0, n).otherwise(at - 1)).where("by > 0")
    far = both.groupBy(*key).agg(*(F.max(F.when(F.col("side") == s, F.struct("by", F.element_at("reach", F.col("by")).alias("to"), F.element_at("more", F.col("by")).alias("halves")))).alias(name) for s, name in ((0, "before"), (1, "after"))))
    out = runs.select(*key, "start", "end", "halves", "first_doc_id").join(far, key, "left")
    halves = F.col("halves") + F.coalesce("before.halves", F.lit(0)) + F.coalesce("after.halves", F.lit(0))
    return out.select("doc_id", "text_id", F.coalesce("before.to", "start").alias("start"), F.coalesce("after.to", "end").alias("end"), F.floor(halves / 2).alias("n_words"), "first_doc_id")


def _text_id(text: str) -> Column:
    """What tells texts of one document id apart: 31 bits of a hash."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")


def _repeats(docs: DataFrame, min_words: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id("text").alias("text_id"), "text").where("doc_id is not null and text is not null")
    chunks = rows.mapInArrow(_chunks, _CHUNKS)
    often = chunks.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    often = cut(often.where("n > 1").select("d", "first"))
    hit = cut(chunks.join(often, F.col("digest") == F.col("d")).drop("d"))
    w = Window.partitionBy("doc_id", "text_id").orderBy("k")
    again = hit.where("first < doc_id or again").distinct()
    new = F.col("k") != F.lag("k").over(w) + 1
    runs = again.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w)).groupBy("doc_id", "text_id", "run")
    chunk = F.struct("digest", "first")
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("halves").alias("halves"), F.min("first").alias("first_doc_id"), F.min_by(chunk, "k").alias("left"), F.max_by(chunk, "k").alias("right"))
    runs = cut(runs.where(F.col("halves") >= 2 * SEED_WORDS))
    firsts = hit.where("first = doc_id and not again").groupBy(F.col("digest").alias("d")).agg(F.min(F.struct("start", "end")).alias("at"))
    return _grown(rows, runs, firsts).where(F.col("n_words") >= min_words)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, end, n_words, first_doc_id)`` of each passage of ``docs(doc_id, text)`` that a smaller id, or the text before it, has.

    Texts are cut into chunks by content, so that equal passages of some 30 words or more share whole chunks wherever they
    stand. Chunks meet by 64-bit digest; of a digest, the smallest id is the first. What two different chunks of one digest could add is far below ``min_words``. Consecutive repeated chunks make a passage, also
    where their firsts differ, as in a copy of an edited copy. It then grows word by word, up to ``CONTEXT`` at each end, as far as it
    agrees with the first occurrence of its outer chunk, whatever white space stands between words; passages of ``min_words`` words or more count, and ``first_doc_id`` is the
    smallest of its chunks' firsts. ``start`` and ``end`` count code points. Words of more than ``LONG_WORD`` bytes, as in texts
    without spaces, are taken by code points, two of which count as a word. Null ids and null texts are left out; rows of one
    id count as one document; other columns are ignored.
    """
    return _repeats(docs, min_words).drop("text_id")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without their repeated passages; ``n_chars``, if there, follows. Documents of which nothing is left are dropped."""
    spans = _repeats(docs, min_words).groupBy(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text"))
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    joined = docs.join(spans, (F.col("doc_id").cast("long") == F.col("__doc")) & (_text_id("text") == F.col("__text")), "left").drop("__doc", "__text")
    at = joined.columns.index("text")

    @lean
    def shorten(batches):
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist()
            for i, (text, cuts) in enumerate(zip(texts, spans, strict=True)):
                if cuts:
                    kept, to = [], 0
                    for c in cuts:  # spans may meet where they have grown
                        kept.append(text[to : c["start"]])
                        to = max(to, c["end"])
                    texts[i] = "".join([*kept, text[to:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    changed = joined.mapInArrow(shorten, joined.schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.where(F.col("__spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)
