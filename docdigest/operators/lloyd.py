"""k-means over executors: groups of any number of rows, each with several numbers of clusters at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdigest.operators.kernels import weighted_start

#: Bytes of centroids that every task holds; groups beyond it wait for the next series of rounds. Distances that are held at once.
SENT_BYTES, HELD_DISTANCES = 64 << 20, 4_000_000
#: Rows drawn for each cluster's start, and at least for each run.
DRAWN, DRAWN_LEAST = 4, 1000

Runs = dict[str, dict[str, int]]
Centroids = dict[tuple[str, str], np.ndarray]


@dataclass(frozen=True)
class Fit:
    """Centroids and inertia of each (group, run)."""

    centroids: Centroids
    inertia: dict[tuple[str, str], float]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def _table(rows: list[tuple], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names.split())


_STRING, _LONG, _DOUBLE, _VECTOR = pa.string(), pa.int64(), pa.float64(), pa.list_(pa.float64())


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Places of each group's rows in a batch; its first column is the group."""
    names = np.array(batch.column(0).to_pylist(), object)
    for g in dict.fromkeys(names.tolist()):
        yield g, np.flatnonzero(names == g)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid and squared distance to it, in pieces of bounded size."""
    size, label, far, norms = (c * c).sum(1), np.empty(len(x), np.int64), np.empty(len(x)), (x * x).sum(1)
    step = max(1, HELD_DISTANCES // len(c))
    for a in range(0, len(x), step):
        d = size - 2 * (x[a : a + step] @ c.T)
        label[a : a + step] = d.argmin(1)
        far[a : a + step] = d.min(1) + norms[a : a + step]
    return label, far


def _sent(rows: DataFrame, values: dict):
    """Small values of each (group, run), by group, for all tasks."""
    by_group: dict[str, dict] = {}
    for (g, run), value in values.items():
        by_group.setdefault(g, {})[run] = value
    return rows.sparkSession.sparkContext.broadcast(by_group)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _sums(rows: DataFrame, centroids: Centroids, unit: bool = False) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray, float]]:
    """Of each (group, run), the members and sums of each cluster (with ``unit``, of rows of length 1), and the inertia: every task adds up its rows first."""
    sent = _sent(rows, centroids)

    def add(batches):
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            x = _matrix(batch.column(3))
            for g, at in _groups(batch):
                for run, c in sent.value.get(g, {}).items():
                    n, total, inertia = held.setdefault((g, run), [np.zeros(len(c), np.int64), np.zeros(c.shape), 0.0])
                    label, far = _nearest(x[at], c)
                    order = np.argsort(label, kind="stable")
                    names, first = np.unique(label[order], return_index=True)
                    total[names] += np.add.reduceat((_unit(x[at]) if unit else x[at])[order], first)
                    n += np.bincount(label, minlength=len(c))
                    held[g, run][2] = inertia + float(far.clip(0).sum())
        for (g, run), (n, total, inertia) in held.items():
            for a in range(0, len(n), 256):
                own = a + np.flatnonzero(n[a : a + 256])
                share = np.where(own == np.flatnonzero(n)[0], inertia, 0.0)
                columns = [pa.array([g] * len(own), pa.string()), pa.array([run] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(n[own]), pa.array(list(total[own]), pa.list_(pa.float64())), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, ["g", "run", "cluster", "n", "total", "inertia"])

    found = rows.mapInArrow(add, "g string, run string, cluster int, n long, total array<double>, inertia double")
    whole = found.groupBy("g", "run", "cluster").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("inertia").alias("inertia"))
    out = {key: [np.zeros(len(c), np.int64), np.zeros(c.shape), 0.0] for key, c in centroids.items()}
    for r in whole.toLocalIterator():
        n, total, _ = out[r.g, r.run]
        n[r.cluster], total[r.cluster] = r.n, r.total
        out[r.g, r.run][2] += r.inertia
    return {key: tuple(v) for key, v in out.items()}


def _farthest(rows: DataFrame, centroids: Centroids) -> dict[tuple[str, str], np.ndarray]:
    """The row of each (group, run) that is farthest from its centroid, the first of equals. One row of each task is looked at."""
    sent = _sent(rows, centroids)

    def seek(batches):
        best: dict[tuple[str, str], tuple] = {}
        for batch in batches:
            x, doc, i = _matrix(batch.column(3)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for g, at in _groups(batch):
                for run, c in sent.value.get(g, {}).items():
                    far = _nearest(x[at], c)[1]
                    for j in np.flatnonzero(far == far.max()).tolist():
                        one = (-far[j], doc[at[j]], i[at[j]], x[at[j]].tolist())
                        if (g, run) not in best or one[:3] < best[g, run][:3]:
                            best[g, run] = one
        if best:
            yield _table([(*key, *one) for key, one in best.items()], [_STRING, _STRING, _DOUBLE, _STRING, _LONG, _VECTOR], "g run far doc_key sent_idx row")

    found = rows.mapInArrow(seek, "g string, run string, far double, doc_key string, sent_idx long, row array<double>")
    first = found.groupBy("g", "run").agg(F.min_by("row", F.struct("far", "doc_key", "sent_idx")).alias("row"))
    return {(r.g, r.run): np.array(r.row) for r in first.collect()}


def spread(rows: DataFrame) -> dict[str, tuple[int, np.ndarray, float]]:
    """Of each group, the number of rows, their mean, and the mean variance of a component."""

    def add(batches):
        held: dict[str, list] = {}
        for batch in batches:
            x = _matrix(batch.column(3))
            for g, at in _groups(batch):
                own = held.setdefault(g, [0, 0.0, 0.0])
                own[0] += len(at)
                own[1] = own[1] + x[at].sum(0)
                own[2] += float((x[at] ** 2).sum())
        if held:
            yield _table([(g, n, total.tolist(), squares) for g, (n, total, squares) in held.items()], [_STRING, _LONG, _VECTOR, _DOUBLE], "g n total squares")

    found = rows.mapInArrow(add, "g string, n long, total array<double>, squares double")
    whole = found.groupBy("g").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("squares").alias("squares"))
    out = {}
    for r in whole.toLocalIterator():
        mean = np.array(r.total) / r.n
        out[r.g] = (r.n, mean, max(0.0, (r.squares / r.n - float(mean @ mean)) / len(mean)))
    return out


def starts(rows: DataFrame, runs: Runs, about: dict[str, tuple[int, np.ndarray, float]], seed: int) -> Centroids:
    """k-means++ starts of each run from weighted rows: a row is drawn by half its share of all rows and half its share of the squared distances to the mean.

    ``DRAWN`` rows for each cluster are drawn in one pass and weigh as much as the rows they stand for; each run's rows meet in one task.
    """
    sent = rows.sparkSession.sparkContext.broadcast({g: (about[g], tuple(own.items())) for g, own in runs.items() if g in about})

    def draw(batches):
        for batch in batches:
            x, out = _matrix(batch.column(3)), []
            u = (batch.column(4).to_numpy().astype(np.uint64) >> np.uint64(11)) / float(1 << 53)
            for g, at in _groups(batch):
                if g not in sent.value:
                    continue
                (n, mean, var), own = sent.value[g]
                total = var * len(mean) * n
                q = np.full(len(at), 1 / n) if total <= 0 else 0.5 / n + 0.5 * ((x[at] - mean) ** 2).sum(1) / total
                for i, (run, k) in enumerate(own):
                    share = np.minimum(1, q * max(DRAWN * k, DRAWN_LEAST))
                    for j in np.flatnonzero((u[at] + 0.6180339887498949 * i) % 1 < share).tolist():
                        out.append((g, run, k, batch.column(1)[int(at[j])].as_py(), batch.column(2)[int(at[j])].as_py(), 1 / share[j], x[at[j]].tolist()))
            if out:
                yield _table(out, [_STRING, _STRING, pa.int32(), _STRING, _LONG, _DOUBLE, _VECTOR], "g run k doc_key sent_idx weight row")

    def start(pdf):
        pdf = pdf.sort_values(["doc_key", "sent_idx"], kind="stable", na_position="first")
        x = np.stack(pdf["row"].to_numpy())
        at = weighted_start(x, pdf["weight"].to_numpy(), int(pdf["k"].iloc[0]), np.random.default_rng([seed, len(pdf)]))
        return pdf.iloc[at].assign(cluster=np.arange(len(at), dtype=np.int32))[["g", "run", "cluster", "row"]]

    marked = rows.withColumn("h", F.xxhash64(F.lit(seed), "g", "doc_key", "sent_idx"))
    drawn = marked.mapInArrow(draw, "g string, run string, k int, doc_key string, sent_idx long, weight double, row array<double>")
    found = drawn.groupBy("g", "run").applyInPandas(start, "g string, run string, cluster int, row array<double>")
    out: dict[tuple[str, str], list] = {}
    for r in found.toLocalIterator():
        out.setdefault((r.g, r.run), []).append((r.cluster, r.row))
    return {key: np.array([row for _, row in sorted(c)], float) for key, c in out.items()}


def lloyd(rows: DataFrame, centroids: Centroids, about: dict[str, tuple[int, np.ndarray, float]], max_iter: int = 300, tol: float = 1e-4) -> Fit:
    """Lloyd steps from given centroids of every (group, run): one pass over ``rows(g, doc_key, sent_idx, embedding)`` a round moves all that still move.

    The same steps as the kernel: a cluster without rows moves to the row farthest from its centroid, and a run ends when
    its centroids move less than ``tol`` times the mean variance. What comes back of a round is a sum for each cluster.
    """
    done: Centroids = {}
    moving = dict(centroids)
    for _ in range(max_iter):
        if not moving:
            break
        sums = _sums(rows, moving)
        empty = {key: moving[key] for key, (n, _, _) in sums.items() if (n == 0).any()}
        far = _farthest(rows, empty) if empty else {}
        for key, (n, total, _) in sums.items():
            new = total / np.maximum(n, 1)[:, None]
            if key in far:
                new[n == 0] = far[key]
            moved, moving[key] = ((new - moving[key]) ** 2).sum(), new
            if moved <= tol * about[key[0]][2]:
                done[key] = moving.pop(key)
    done |= moving
    return Fit(done, {key: inertia for key, (_, _, inertia) in _sums(rows, done).items()})


def series(runs: Runs, dim: int) -> Iterator[Runs]:
    """Runs in series whose centroids fit all tasks together; one run alone must fit."""
    held, size = {}, 0
    for g, own in runs.items():
        for run, k in own.items():
            need = 8 * dim * k
            if need > SENT_BYTES:
                raise ValueError(f"{k} centroids of {dim} components are more than SENT_BYTES")
            if size + need > SENT_BYTES:
                yield held
                held, size = {}, 0
            held.setdefault(g, {})[run] = k
            size += need
    if held:
        yield held


def fit(rows: DataFrame, runs: Runs, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> Fit:
    """k-means of each group for each of its runs (name and number of clusters). ``rows`` should be written or cached: each round reads them once."""
    rows = rows.select("g", "doc_key", F.col("sent_idx").cast("long").alias("sent_idx"), "embedding")
    about = spread(rows)
    centroids, inertia = {}, {}
    for part in series({g: own for g, own in runs.items() if g in about}, max((len(m) for _, m, _ in about.values()), default=1)):
        some = rows.where(F.col("g").isin(list(part)))
        found = lloyd(some, starts(some, part, about, seed), about, max_iter, tol)
        centroids |= found.centroids
        inertia |= found.inertia
    return Fit(centroids, inertia)


def assign(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """``(g, run, doc_key, sent_idx, cluster_id, distance)`` of each row and run, the distance squared."""
    sent = _sent(rows, centroids)

    def label(batches):
        for batch in batches:
            x = _matrix(batch.column(3))
            for g, at in _groups(batch):
                for run, c in sent.value.get(g, {}).items():
                    n, to = len(at), _nearest(x[at], c)[0]
                    far = np.empty(n)
                    for a in range(0, n, 1000):
                        far[a : a + 1000] = ((x[at[a : a + 1000]] - c[to[a : a + 1000]]) ** 2).sum(1)
                    columns = [pa.array([g] * n), pa.array([run] * n), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(to, pa.int32()), pa.array(far)]
                    yield pa.RecordBatch.from_arrays(columns, ["g", "run", "doc_key", "sent_idx", "cluster_id", "distance"])

    rows = rows.select("g", "doc_key", F.col("sent_idx").cast("int").alias("sent_idx"), "embedding")
    return rows.mapInArrow(label, "g string, run string, doc_key string, sent_idx int, cluster_id int, distance double")


def silhouettes(rows: DataFrame, centroids: Centroids) -> dict[tuple[str, str], float | None]:
    """The mean silhouette of each (group, run) under cosine distance, from sums of unit vectors: no pair of rows is formed. None unless 2 to n - 1 clusters have rows."""
    rows = rows.select("g", "doc_key", F.col("sent_idx").cast("long").alias("sent_idx"), "embedding")
    sums = {key: v[:2] for key, v in _sums(rows, centroids, unit=True).items()}
    sent = _sent(rows, {key: (centroids[key], *v) for key, v in sums.items() if 2 <= np.count_nonzero(v[0]) < v[0].sum()})

    def judge(batches):
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            x = _matrix(batch.column(3))
            for g, at in _groups(batch):
                for run, (c, n, total) in sent.value.get(g, {}).items():
                    own = held.setdefault((g, run), [0.0, 0])
                    step = max(1, HELD_DISTANCES // len(c))
                    for lo in range(0, len(at), step):
                        part = x[at[lo : lo + step]]
                        u, to, i = _unit(part), _nearest(part, c)[0], np.arange(len(part))
                        far = n[None] - u @ total.T
                        a = (far[i, to] - (1 - (u * u).sum(1))) / np.maximum(n[to] - 1, 1)
                        far = np.where(n[None] > 0, far / np.maximum(n, 1)[None], np.inf)
                        far[i, to] = np.inf
                        b = far.min(1)
                        most = np.maximum(a, b)
                        own[0] += float(np.where(n[to] == 1, 0.0, (b - a) / np.where(most == 0, 1, most)).sum())
                        own[1] += len(part)
        if held:
            yield _table([(*key, *v) for key, v in held.items()], [_STRING, _STRING, _DOUBLE, _LONG], "g run s n")

    found = rows.mapInArrow(judge, "g string, run string, s double, n long").groupBy("g", "run").agg((F.sum("s") / F.sum("n")).alias("s"))
    return dict.fromkeys(centroids) | {(r.g, r.run): r.s for r in found.toLocalIterator()}
