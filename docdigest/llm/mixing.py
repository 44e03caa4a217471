"""Mixing sources to target weights by drawing fixed-length blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docdigest.llm.common import cut, lean, mix64, word_bounds

#: Words of a block.
BLOCK = 64
#: Blocks of an output shard, on average.
SHARD_BLOCKS = 4096
#: Documents of one packing group, at most about. Groups of a source are packed next to each other.
GROUP = 2_000
#: Output shards whose slots are drawn together.
SHARDS = 16
#: Tasks that draw slots at most. Their rows are small but each makes about ``SHARDS * SHARD_BLOCKS``, so Spark must not gather them by size.
DRAWING = 20_000
#: Weights of the sources in code point order, repeating; share of all words that the mix has; times that a source may be used.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their ``rank`` by code point, null last: ranges are counted, and ranked side by side."""
    order = F.col("source").asc_nulls_last()
    ranges = cut(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return ranges.withColumn("own", own).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("own")).drop("range", "own", "before")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: a share of all words by weight, at most ``most`` times the source's own.

    What a source cannot take is shared again by weight among those below their limit, until none is above. Each round
    gathers two sums.
    """
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = cut(_ranked(sources).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("full", F.col("source_size") == 0))
    wanted = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        held, free, n = s.agg(F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)), F.count("*")).first()
        each = max(0.0, wanted - (held or 0.0)) / free if free else 0.0
        over = ~F.col("full") & (F.col("weight") * each > F.col("limit"))
        if not n or s.where(over).isEmpty():
            return s.select(*sources.columns, F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * each).alias("target"))
        s = cut(s.withColumn("full", F.col("full") | over))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, applied to ``index``: four Feistel rounds on the next even number of bits, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x >> np.uint64(half), x & mask
            for r in range(4):
                left, right = right, left ^ (mix64(right + np.uint64((key + r * 0x9E3779B97F4A7C15) % 2**64)) & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _own(seed: int, key: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}/{key}")


def _shares(seed: int, shards: int):
    """Of rows (source_key, blocks, slots): the source's slots dealt by a multinomial draw to groups of shards, as (source_key, blocks, first shard, first slot, count)."""

    def share(batches):
        first = np.arange(0, shards, SHARDS)
        size = np.minimum(SHARDS, shards - first)
        for batch in batches:
            for key, blocks, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = np.random.default_rng([seed, _own(seed, key)]).multinomial(slots, size / shards)
                slot = np.cumsum(count) - count
                for at in range(0, len(first), 1 << 14):
                    part = slice(at, at + (1 << 14))
                    n = len(first[part])
                    columns = [pa.array([key] * n, pa.string()), pa.array(np.full(n, blocks)), *(pa.array(x[part]) for x in (first, slot, count))]
                    yield pa.RecordBatch.from_arrays(columns, ["source_key", "blocks", "shard", "slot", "n"])

    return share


def _draw(seed: int, shards: int):
    """Of such rows: how many slots of the source each shard gets, by a multinomial draw, and each slot's shard and block."""

    @lean
    def draw(batches):
        for batch in batches:
            for key, blocks, shard, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, size = _own(seed, key), min(SHARDS, shards - shard)
                drawn = np.random.default_rng([seed, own, shard]).multinomial(count, np.full(size, 1 / size))
                slot = np.arange(first, first + count)
                turn = slot // blocks
                block = np.empty(count, np.int64)
                for t in np.unique(turn).tolist():
                    block[turn == t] = permute(slot[turn == t] % blocks, blocks, (own + t) % 2**64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * count, pa.string()), pa.array(slot), pa.array(shard + np.repeat(np.arange(size), drawn)), pa.array(block)], ["source_key", "slot", "shard", "block"])

    return draw


def pack(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documents, sources)``: documents with their size and the word they start at in the stream of their source, and each source's size.

    Sources are packed in groups of documents by a hash of the id, each ordered by id, so that no task gets a whole source.
    """
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    sized = cut(sized.select("doc_id", "source", F.xxhash64("text").alias("tie"), "size").withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    counts = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    counts = cut(counts)
    spread = sized.join(F.broadcast(counts.select("source_key", "groups")) if counts.limit(100_001).count() <= 100_000 else counts.select("source_key", "groups"), "source_key")
    spread = cut(spread.withColumn("group", F.pmod(F.xxhash64("doc_id", "tie"), F.col("groups")).cast("int")))
    before = spread.groupBy("source_key", "group").agg(F.sum("size").alias("words"))
    before = cut(before.withColumn("first", F.sum("words").over(Window.partitionBy("source_key").orderBy("group")) - F.col("words")).drop("words"))
    inside = Window.partitionBy("source_key", "group").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = spread.drop("groups").withColumn("at", F.sum("size").over(inside) - F.col("size")).join(before, ["source_key", "group"])
    return rows.select("doc_id", "source", "source_key", "tie", "size", (F.col("first") + F.col("at")).alias("start")), counts.select("source", "source_key", "source_size")


def draw_blocks(sources: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``(source_key, slot, shard, block)``: the blocks that the mix takes, once for each time.

    A source gets its target in slots. How many of them each output shard has is drawn: multinomially over groups of shards,
    then inside each group; so a shard's counts of sources are multinomial given the sources' totals, which are met to a
    block. A shard has consecutive slots of a source, and slot i takes block p(i mod n) of the source's n, with another
    permutation p for each turn: no block is taken twice before all are taken once.
    """
    n = F.ceil(F.col("source_size") / block).cast("long")
    planned = sources.where("source_size > 0").withColumn("blocks", n).withColumn("slots", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"))
    planned = cut(planned.select("source_key", "blocks", "slots").where("slots > 0"))
    total = planned.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, round(total / SHARD_BLOCKS))
    parts = planned.mapInArrow(_shares(seed, shards), "source_key string, blocks long, shard long, slot long, n long").where("n > 0")
    parts = parts.repartition(int(min(DRAWING, total // (2 * SHARDS * SHARD_BLOCKS) + 1)), "source_key", "shard")
    return parts.mapInArrow(_draw(seed, shards), "source_key string, slot long, shard long, block long")


def _pieces(block: int):
    """Of rows (source_key, doc_id, start, size, text): the text's words that stand in each block of the source, as they are written."""

    @lean
    def pieces(batches):
        for batch in batches:
            rows = []
            for key, doc_id, start, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                _, first, last = word_bounds(data)
                for b in range(start // block, (start + size - 1) // block + 1):
                    lo, hi = max(b * block - start, 0), min((b + 1) * block - start, size)
                    rows.append((key, b, doc_id, start, size, lo, hi - lo, data[first[lo] : last[hi - 1]].decode()))
            kinds = [pa.string(), pa.int64(), batch.column(1).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["source_key", "block", "doc_id", "start", "size", "word", "words", "text"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return pieces


def _blocks(docs: DataFrame, packed: DataFrame, sources: DataFrame, seed: int, block: int) -> DataFrame:
    """``(source_key, slot, shard, block, parts)``: the drawn blocks with their text, as parts by document in order."""
    # texts and places meet in one grouping, so that texts shuffle once; repeated rows have one text and a place each
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("text is not null").select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), F.xxhash64("text").alias("tie"), "text", F.lit(None).cast("struct<start:long,size:long>").alias("at"))
    places = packed.where("size > 0").select("doc_id", "source_key", "tie", F.lit(None).cast("string").alias("text"), F.struct("start", "size").alias("at"))
    both = texts.union(places).groupBy("doc_id", "source_key", "tie").agg(F.first("text", ignorenulls=True).alias("text"), F.collect_list("at").alias("places"))
    placed = both.select("source_key", "doc_id", F.explode("places").alias("at"), "text").select("source_key", "doc_id", "at.start", "at.size", "text")
    pieces = placed.mapInArrow(_pieces(block), f"source_key string, block long, doc_id {kind}, start long, size long, word long, words long, text string")
    parts = F.sort_array(F.collect_list(F.struct("start", "doc_id", "size", "word", "words", "text"))).alias("parts")
    drawn = draw_blocks(sources, seed, block).hint("merge")  # Spark takes it for as small as the sources that it is drawn from
    return drawn.join(pieces.groupBy("source_key", "block").agg(parts), ["source_key", "block"]).select("source_key", "slot", "shard", "block", "parts")


def mixed_blocks(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``(shard, source, slot, block, n_words, text, parts)``: the mix of ``docs(doc_id, text, source)``, a row for each block drawn.

    A block has ``block`` words of its source's stream, the last one fewer. ``parts`` are its texts by document, as written
    there: the document's place in the stream (``start``), ``doc_id``, ``size``, the first ``word`` in the document, ``words``
    and ``text``; the row's ``text`` has an empty line between documents. A null source is a source of its own.
    """
    packed, sources = pack(docs.select("doc_id", "text", "source"))
    rows = _blocks(docs, cut(packed), cut(targets(sources, weights, share)), seed, block)
    source = F.when(F.col("source_key") != "", F.expr("substring(source_key, 2)"))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return rows.select("shard", source.alias("source"), "slot", "block", n.alias("n_words"), F.array_join("parts.text", "\n\n").alias("text"), "parts")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, pieces)`` of each row of ``docs(doc_id, text, source)``.

    ``size`` counts the runs of non-space characters of the whole text, 0 for a null text; ``taken`` is how many words of
    the document the mix has, repeats counted, at most twice its size. ``pieces`` are
    these words as the mix has them: ``shard``, ``slot``, first ``word`` in the document, and ``text``; both come from the rows of the mixed blocks. A null source is a source of its own. Repeated rows are
    packed one after the other. The same rows give the same result, however they are partitioned.
    """
    texts = docs.select("doc_id", "text", "source")
    docs, sources = pack(texts)
    sources = cut(targets(sources, weights, share))
    docs = cut(docs)
    mixed = _blocks(texts, docs, sources, seed, block).select("source_key", "shard", "slot", F.explode("parts").alias("p")).select("source_key", "shard", "slot", "p.*")
    pieces = F.sort_array(F.collect_list(F.struct("shard", "slot", "word", "text"))).alias("pieces")
    taken = mixed.groupBy("source_key", "start", "size").agg(F.sum("words").alias("taken"), pieces)
    taken = taken.select(F.col("source_key").alias("k"), F.col("start").alias("s"), F.col("size").alias("z"), "taken", "pieces")
    rows = docs.join(taken, (F.col("source_key") == F.col("k")) & (F.col("start") == F.col("s")) & (F.col("size") == F.col("z")), "left")
    table = sources.select(F.col("source_key").alias("q"), "source_size", "target")
    table = F.broadcast(table) if table.limit(100_001).count() <= 100_000 else table
    return rows.join(table, F.col("source_key") == F.col("q")).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", F.array()).alias("pieces"))
