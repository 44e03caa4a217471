"""Embedding near-dedup: spherical k-means cells of each label, blocked cosine products inside cells, one vector of each group kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdigest.llm.common import cut, lean
from docdigest.llm.components import Forest, connected_components

#: Cosine from which vectors link.
THRESHOLD = 0.93
#: Vectors that the centroids are fitted on at most, vectors of a cell about, cells at most, rounds of the fit.
SAMPLE, PER_CELL, CELLS, ROUNDS = 20_000, 4000, 1024, 8
#: Vectors of a block, and rows of a batch of dealt vectors.
BLOCK, ROWS = 1024, 2000


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit rows; an empty cell keeps its centroid."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        best = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def _unit(batch_column) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what links with nothing."""
    out = []
    for v in batch_column.to_pylist():
        ok = v is not None and len(v) > 0 and None not in v
        x = np.array(v, np.float64) if ok else None
        if ok and np.isfinite(x).all() and (size := np.abs(x).max()) > 0:
            x = x / size
            out.append(x / np.linalg.norm(x))
        else:
            out.append(None)
    return out


@lean
def _clean(batches):
    """Rows (vec_id, label, embedding) with the unit vector's bytes, or null."""
    for batch in batches:
        units = [None if x is None else x.tobytes() for x in _unit(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], ["vec_id", "label", "unit"])


def _cells(centroids: dict[int, np.ndarray], threshold: float):
    """For each vector its cell and the cells that it has to be compared in. A part without centroids is one cell.

    A vector of cell c' is also dealt to cell c when it is within half the chord of the threshold of the plane that parts
    the two: of two linking vectors in different cells, one is that near to the plane between them. So no link is lost.
    """
    reach = np.sqrt((1 - threshold) / 2) + 1e-9
    gaps = {p: np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) for p, c in centroids.items()}

    @lean
    def deal(batches):
        for batch in batches:
            rows, labels, parts, units = (batch.column(i).to_pylist() for i in range(4))
            by_part: dict[int, list[int]] = {}
            for i, part in enumerate(parts):
                by_part.setdefault(part if part in centroids else None, []).append(i)
            out = []
            for part, members in by_part.items():
                if part is None:
                    out += [(rows[i], labels[i], len(units[i]) // 8, 0, 0, [0], units[i]) for i in members]
                    continue
                dot = np.frombuffer(b"".join(units[i] for i in members)).reshape(len(members), -1) @ centroids[part].T
                home = dot.argmax(1)
                close = dot.max(1)[:, None] - dot <= reach * gaps[part][home] + 1e-7
                for i, own, cells in zip(members, home.tolist(), close, strict=True):
                    near = np.flatnonzero(cells).tolist()
                    out += [(rows[i], labels[i], len(units[i]) // 8, cell, own, near, units[i]) for cell in near]
            kinds = [batch.column(0).type, batch.column(1).type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
            for at in range(0, len(out), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[at : at + ROWS]], kind) for i, kind in enumerate(kinds)], ["row", "label", "dim", "cell", "home", "near", "unit"])

    return deal


def _centroids(good: DataFrame) -> dict[int, np.ndarray]:
    """By part, a label's vectors of one dimension, its centroids. Parts of fewer than two cells have none."""
    large = good.groupBy("part").count().where(F.col("count") >= 2 * PER_CELL).orderBy(F.desc("count"), "part").limit(CELLS // 2)
    cells = {r["part"]: r["count"] // PER_CELL for r in large.collect()}
    total = sum(cells.values())
    picked: dict[int, list[bytes]] = {}
    if cells:
        for part, unit in good.where(F.col("part").isin(list(cells))).orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("part", "unit").collect():
            picked.setdefault(part, []).append(bytes(unit))
    return {p: spherical_kmeans(np.frombuffer(b"".join(u)).reshape(len(u), -1), cells[p] if total <= CELLS else max(1, cells[p] * CELLS // total)) for p, u in picked.items()}


def _compare(threshold: float):
    """Inside one pair of blocks (home rows against all): (vec_id, links, other) with counts, and with edges that connect what links connect."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, all_ = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(mine) or not len(all_):
            return pd.DataFrame({"row": [], "links": [], "other": []}, dtype="int64")
        x, y = (np.frombuffer(b"".join(p["unit"]), np.float64).reshape(len(p), -1) for p in (mine, all_))
        xi, yi = mine["row"].to_numpy(), all_["row"].to_numpy()
        cell, home = int(pdf["cell"].iloc[0]), all_["home"].to_numpy()
        near = x @ y.T >= threshold
        inside = home == cell
        near &= ~inside | (xi[:, None] < yi)  # each pair of one cell once
        cells = [set(n) for n in mine["near"]]
        for other in np.unique(home[home < cell]).tolist():  # a pair that both cells see counts in the smaller
            near[np.ix_(np.array([other in n for n in cells]), home == other)] = False
        i, j = np.nonzero(near)
        forest, edges = Forest(), []
        for a, b in zip(xi[i].tolist(), yi[j].tolist(), strict=True):
            if forest.link(a, b):
                edges.append((a, b))
        out = [pd.DataFrame({"row": xi, "links": near.sum(1), "other": -1}), pd.DataFrame({"row": yi, "links": near.sum(0), "other": -1})]
        out.append(pd.DataFrame(edges, columns=["row", "other"]).assign(links=0))
        both = pd.concat(out)[["row", "links", "other"]].astype("int64")
        return both[(both["links"] > 0) | (both["other"] >= 0)]

    return compare


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``vectors(vec_id, label, embedding)``.

    Vectors of equal, non-null labels link when their cosine in double precision is ``threshold`` or more. Null, zero and
    non-finite vectors, null labels and different dimensions link with nothing. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest ``vec_id`` reached, ``kept`` whether that is the row's own. Rows of one id count each as a vector.
    Centroids are fitted on at most ``SAMPLE`` vectors; all vectors are indexed, and recall is complete by construction.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = vectors.schema["label"].dataType.simpleString()
    clean = rows.mapInArrow(_clean, f"vec_id long, label {kind}, unit binary")
    clean = cut(clean.withColumn("row", F.monotonically_increasing_id()))
    good = clean.where("unit is not null and label is not null and vec_id is not null")
    good = good.withColumn("part", F.xxhash64("label", F.length("unit")))
    dealt = good.select("row", "label", "part", "unit").mapInArrow(_cells(_centroids(good), threshold), f"row long, label {kind}, dim int, cell int, home int, near array<int>, unit binary")
    dealt = cut(dealt.withColumn("own", F.col("home") == F.col("cell")))
    group = ["label", "dim", "cell"]
    sizes = dealt.groupBy(*group).agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).cast("int").alias("homes"), F.ceil(F.count("*") / BLOCK).cast("int").alias("alls"))
    sized = cut(dealt.join(cut(sizes.where("homes > 0")), group))
    left = sized.where("own").withColumn("i", F.pmod(F.xxhash64("row"), F.col("homes")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, alls - 1)"))).withColumn("side", F.lit(0))
    right = sized.withColumn("j", F.pmod(F.xxhash64("row", F.lit(1)), F.col("alls")).cast("int")).withColumn("i", F.explode(F.expr("sequence(0, homes - 1)"))).withColumn("side", F.lit(1))
    columns = [*group, "i", "j", "side", "row", "home", "near", "unit"]
    found = left.select(columns).union(right.select(columns)).groupBy(*group, "i", "j").applyInPandas(_compare(threshold), "row long, links long, other long")
    found = cut(found.groupBy("row", "other").agg(F.sum("links").alias("links")))

    # components over ids: rows of one id are one node
    node = clean.select(F.col("row").alias("r"), F.col("vec_id").alias("v"))
    edges = found.where("other >= 0").select("row", "other")
    edges = edges.join(node, F.col("row") == F.col("r")).select(F.col("v").alias("a"), "other").join(node, F.col("other") == F.col("r")).select("a", F.col("v").alias("b"))
    of = connected_components(edges)
    links = found.groupBy(F.col("row").alias("r")).agg(F.sum("links").alias("n_links"))
    out = clean.drop("unit", "label").join(links, F.col("row") == F.col("r"), "left").join(of, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
