"""The trie of conversations: what they share from their start, peeled from the deepest turns up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docdigest.llm.common import cut, lean

#: Conversations of one family start with turns of its first, whose number is a multiple of this; fewer turns than this are taken.
FAMILY, TAKEN = 20, 4
#: The node of no turns.
ROOT = bytes(16)


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv, i, digest, words)``: turns numbered from 0, told apart by 128 bits of role and text. Texts go no further than this."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv", (F.row_number().over(order) - 1).alias("i"), "digest", "words")


def _rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv, i, digest, words)`` of rebuilt conversations, in order of ``i``; a row of ``i`` -1 for each, so that those without turns are there."""
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % TAKEN
    convs = turns.select("conv").distinct()
    first = turns.where((F.col("conv") % FAMILY == 0) & (F.col("i") < TAKEN - 1)).withColumnRenamed("conv", "first")
    shared = convs.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("first")).join(first, "first").where(F.col("i") < taken).select("conv", "i", "digest", "words")
    return shared.union(turns.where(F.col("i") >= taken)).union(convs.select("conv", F.lit(-1), F.lit(None).cast("binary"), F.lit(0).cast("long")))


@lean
def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (conv, digest, words) in order, a conversation's row without digest first: (conv, depth, node, parent, words, last); a node's name is a digest of its turns."""
    names, kinds = ["conv", "depth", "node", "parent", "words", "last"], (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    held = None
    for batch in batches:
        out = []
        for conv, digest, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is None:
                if held:
                    out.append((*held, True))
                held = (conv, 0, ROOT, None, 0)
                continue
            if held[1]:
                out.append((*held, False))
            held = (conv, held[1] + 1, hashlib.blake2b(held[2] + digest, digest_size=16).digest(), held[2], words)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*held, True), kinds, strict=True)], names)


@lean
def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, depth, conv) in order, each node's smallest and number of conversations that end in it, and the digest of their numbers. The digest grows number by number: no list is held."""
    at, depth, least, n, sha = None, 0, 0, 0, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([depth], pa.int64()), pa.array([least], pa.int64()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], ["node", "depth", "conv", "n", "ends"])

    for batch in batches:
        done = []
        for node, d, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != at:
                if at is not None:
                    done.append(row())
                at, depth, least, n, sha = node, d, conv, 0, hashlib.sha256()
            sha.update(f",{conv}".encode() if n else str(conv).encode())
            n += 1
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if at is not None:
        yield row()


_STEP = "struct<node: binary, words: bigint>"


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: a row for each distinct start of rebuilt conversations.

    A conversation takes the first turns of its family's first before its own. Null roles and texts are empty; rows of a null ``conv_id``
    belong to no conversation; turns without a number come first; rows of one number come in order of a digest of role and text, and
    repeated rows are turns of their own. Without conversations there are no nodes.

    Equal conversations are one sequence. A sequence's turns behind the last node that another sequence shares are peeled at once; what is left of it
    joins the shared nodes of its depth. From the deepest of these up, each round merges the sequences that end or join there with the nodes that
    survived, counts, and strips the last turn. So there are as many rounds as turns that two different sequences share, and a row
    takes part as long as its node does. One conversation's turns are one sorted run of a task, which holds one turn at a time.
    """
    turns = cut(_turns(conversations))
    path = _rebuilt(turns).repartition("conv").sortWithinPartitions("conv", "i").select("conv", "digest", "words")
    path = cut(path.mapInArrow(_chain, "conv long, depth long, node binary, parent binary, words long, last boolean"))
    ends = path.where("last").select("node", "depth", "conv").repartition("node").sortWithinPartitions("node", "conv")
    ends = cut(ends.mapInArrow(_ends, "node binary, depth long, conv long, n long, ends string"))

    # one conversation stands for each sequence; top is the depth of its deepest node that another sequence has too
    own = cut(path.drop("last").join(ends.select("conv", "n", F.col("depth").alias("length")), "conv"))
    shared = own.where("depth > 0").groupBy("node").agg(F.count("*").alias("sequences")).where("sequences > 1").select("node")
    tops = own.join(shared, "node").groupBy("conv").agg(F.max("depth").alias("top"))
    own = cut(own.join(tops, "conv", "left").withColumn("top", F.coalesce("top", F.lit(0))))

    below = Window.partitionBy("conv").orderBy(F.desc("depth"))
    tail = own.where("depth > top").withColumn("saved", F.sum((F.col("n") - 1) * F.col("words")).over(below))
    tail = tail.select("conv", "depth", "node", "parent", "n", (F.col("depth") < F.col("length")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), "saved", (F.col("depth") == F.col("top") + 1).alias("joins"))
    tail = cut(tail)

    # what arrives at a shared node: sequences that end there, and tails that hang from it
    steps = own.where("depth <= top and depth > 0").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "words"))).alias("s"))
    steps = steps.select("conv", F.transform("s", lambda s: F.struct(s["node"].alias("node"), s["words"].alias("words"))).alias("path"))
    zero = F.lit(0).cast("long")
    ending = own.where("depth = length and depth <= top").select("conv", F.col("depth").alias("at"), "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"))
    hanging = tail.where("joins").select("conv", (F.col("depth") - 1).alias("at"), "n", F.lit(1).cast("long").alias("children"), "leaves", "saved")
    arrivals = ending.union(hanging).join(steps, "conv", "left").withColumn("path", F.coalesce("path", F.array().cast(f"array<{_STEP}>")))
    arrivals = cut(arrivals)

    found = tail.select("conv", "depth", "node", "parent", "n", "children", "leaves", "saved")
    deepest = arrivals.agg(F.max("at")).first()[0]
    alive = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        rows = arrivals.where(F.col("at") == depth).drop("at")
        rows = rows if alive is None else rows.unionByName(alive)
        name = lambda i: F.col("path")[i]["node"] if i >= 0 else F.lit(ROOT)
        level = rows.groupBy(name(depth - 1).alias("node")).agg(F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.any_value("path").alias("path"))
        words = F.col("path")[depth - 1]["words"] if depth else zero
        level = level.withColumns({"leaves": F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")), "saved": F.col("saved") + (F.col("n") - 1) * words})
        level = cut(level)
        parent = name(depth - 2) if depth else F.lit(None).cast("binary")
        found = found.union(level.select("conv", F.lit(depth).cast("long"), "node", parent, "n", "children", "leaves", "saved"))
        # the last turn goes; a node is one child of what is left of it
        alive = level.select("conv", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved", F.slice("path", 1, depth - 1).alias("path")) if depth else None

    found = cut(found)
    parents = found.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = found.join(parents, "parent", "left").join(ends.select("node", "ends"), "node", "left")
    counts = (F.col(c).alias(name) for c, name in (("n", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens")))
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", *counts, F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
