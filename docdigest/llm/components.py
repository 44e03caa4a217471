"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdigest.llm.common import cut, lean

#: Nodes that one local contraction holds in memory at once, and edges for each task of a later one.
LOCAL_EDGES = 200_000


_EDGE = "hi long, lo long"


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def link(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        lo, hi = (x, y) if x < y else (y, x)
        self.parent[hi] = lo
        return True


@lean
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that connect what a task's edges connect; a new forest is begun when one has more than ``LOCAL_EDGES`` nodes."""
    forest = Forest()

    def stars():
        nodes = list(forest.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["hi", "lo"])

    for batch in batches:
        for hi, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.link(hi, lo)
            if len(forest.parent) > LOCAL_EDGES:
                yield stars()
                forest = Forest()
    if forest.parent:
        yield stars()


def _gathered(e: DataFrame) -> DataFrame:
    """Edges contracted again in as few tasks as hold ``LOCAL_EDGES`` each, where these are fewer than now."""
    tasks = -(-e.count() // LOCAL_EDGES)
    if not 0 < tasks < e.rdd.getNumPartitions():
        return e
    e = e.coalesce(tasks).mapInArrow(_contract, _EDGE)
    return cut(e if tasks == 1 else e.distinct())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", native: bool = False, thinned: bool = False) -> DataFrame:
    """The ``(node, component)`` rows of every node that is not the smallest of its component; ``component`` is the smallest node.

    Alternates large-star and small-star steps over edges that point to a smaller node, until only stars are left: every step
    takes minima by node, which are pre-aggregated before they shuffle, and joins them back. The minima are written before
    the join, so both of its sides are shuffled and Spark can split a hub's partition. With ``native`` no Python runs on
    executors; else each task's edges are first thinned to a spanning forest, but for edges that come ``thinned``, and each round
    begins by thinning again in fewer tasks, as many as hold a bounded number of edges each. Nulls and self-loops are ignored.
    """
    a, b = F.col(a), F.col(b)
    e = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = (e if native or thinned else e.mapInArrow(_contract, _EDGE)).distinct()
    e = e if native else e.mapInArrow(_contract, _EDGE)
    e = cut(e)
    while not _is_stars(e := e if native else _gathered(e)):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = cut(large)
        low = cut(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "n"))
        joined = large.join(low, F.col("hi") == F.col("n"))
        e = joined.select("hi", F.col("m").alias("lo")).union(joined.where("lo != m").select("lo", "m"))
        e = cut((e if native else e.mapInArrow(_contract, _EDGE)).distinct())
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _is_stars(e: DataFrame) -> bool:
    """Whether each larger end has one edge, and is nobody's smaller end."""
    ends = e.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()
