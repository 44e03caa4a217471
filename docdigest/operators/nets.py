"""Training nets over executors: gradients of each group are added up in tasks, then over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdigest.operators import lloyd
from docdigest.operators.kernels import Net

#: Rows whose activations a task holds.
ROWS = 2000


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([p.size for p in like])[:-1]
    return [part.reshape(p.shape) for part, p in zip(np.split(flat, cuts), like, strict=True)]


def _pass(rows: DataFrame, nets: dict[str, Net]) -> dict[str, tuple[np.ndarray, float, float, int]]:
    """Of each group, gradients and loss of its training rows, and loss and right answers of its validation rows, all summed."""
    sent = rows.sparkSession.sparkContext.broadcast(nets)

    def add(batches):
        held: dict[str, list] = {}
        for batch in batches:
            part = np.array(batch.column(3).to_pylist(), object) == "train"
            for g, at in lloyd._groups(batch):
                if (net := sent.value.get(g)) is None:
                    continue
                own = held.setdefault(g, [np.zeros(sum(p.size for p in net.params)), 0.0, 0.0, 0])
                for lo in range(0, len(at), ROWS):
                    some = at[lo : lo + ROWS]
                    x, y = lloyd._matrix(batch.column(4).take(pa.array(some))), batch.column(2).take(pa.array(some)).to_numpy().astype(float)
                    learn = part[some]
                    if learn.any():
                        loss, gradients = net.gradients(x[learn], y[learn], batch.column(1).take(pa.array(some[learn])).to_numpy())
                        own[0] += _flat(gradients)
                        own[1] += loss
                    if not learn.all():
                        loss, right = net.judge(x[~learn], y[~learn])
                        own[2] += loss
                        own[3] += right
        if held:
            yield lloyd._table([(g, v[0].tolist(), *v[1:]) for g, v in held.items()], [pa.string(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64()], "g gradient train val right")

    found = rows.mapInArrow(add, "g string, gradient array<double>, train double, val double, right long")
    whole = found.groupBy("g").agg(vector_to_array(Summarizer.sum(array_to_vector("gradient"))).alias("gradient"), *(F.sum(c).alias(c) for c in ("train", "val", "right")))
    return {r.g: (np.array(r.gradient), r.train, r.val, r.right) for r in whole.toLocalIterator()}


def train(rows: DataFrame, sizes: dict[str, tuple[int, int]], epochs: int = 15, lr: float = 0.005, hidden=(128, 32), dropout: float = 0.3, seed: int = 42) -> dict[str, tuple[list[float], list[float], float]]:
    """Losses of each epoch (training, validation) and the final accuracy of each group of ``rows(g, sent_idx, label, part, embedding)``.

    ``sizes`` has each group's training and validation rows. One pass an epoch trains all groups whose nets fit the tasks together; the
    same losses as the kernel's, as a row's dropout follows from its number. ``rows`` should be written: every pass reads them.
    """
    if not sizes:
        return {}
    dim = len(rows.first()["embedding"])
    need = sum(p.size for p in Net(dim, hidden).params)
    out = {}
    # a net and its two moments weigh as much as three centroids of its size
    for part in lloyd.series({g: {"net": 3} for g in sizes}, need):
        nets = {g: Net(dim, hidden, lr, dropout, seed) for g in part}
        some = rows.where(F.col("g").isin(list(part)))
        losses: dict[str, tuple[list, list]] = {g: ([], []) for g in part}
        right: dict[str, int] = {}
        for epoch in range(epochs + 1):  # what a pass says of validation is the last epoch's
            for g, (gradient, a, b, told) in _pass(some, nets).items():
                if epoch:
                    losses[g][1].append(b / sizes[g][1])
                    right[g] = told
                if epoch < epochs:
                    losses[g][0].append(a / sizes[g][0])
                    nets[g].step(_shaped(gradient / sizes[g][0], nets[g].params))
        out |= {g: (a, b, right[g] / sizes[g][1]) for g, (a, b) in losses.items()}
    return out
