"""Small numeric helpers that run inside tasks; NumPy only."""

from __future__ import annotations

import numpy as np


def _start(x: np.ndarray, norms: np.ndarray, k: int, rng) -> np.ndarray:
    """Rows of k-means++ starts."""
    at = [int(rng.integers(len(x)))]
    d = np.full(len(x), np.inf)
    while True:
        d = np.minimum(d, norms - 2 * (x @ x[at[-1]]) + norms[at[-1]]).clip(0)
        if len(at) == k:
            return np.array(at)
        total = np.cumsum(d)
        at.append(min(int(np.searchsorted(total, rng.random() * total[-1], "right")), len(x) - 1) if total[-1] > 0 else int(rng.integers(len(x))))


def starts(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """The k-means++ starts of ``kmeans``' first run; its starts for fewer clusters are the first of them."""
    return x[_start(x, (x * x).sum(1), k, np.random.default_rng([seed, 0]))]


def weighted_start(x: np.ndarray, weight: np.ndarray, k: int, rng) -> np.ndarray:
    """Rows of k-means++ starts where a row stands for ``weight`` rows."""
    d, at = np.ones(len(x)), []
    for _ in range(k):
        total = np.cumsum(d * weight)
        at.append(min(int(np.searchsorted(total, rng.random() * total[-1], "right")), len(x) - 1) if total[-1] > 0 else int(rng.integers(len(x))))
        far = ((x - x[at[-1]]) ** 2).sum(1)
        d = far if len(at) == 1 else np.minimum(d, far)
    return np.array(at)


def kmeans(x: np.ndarray, k: int, seed: int = 42, n_init: int = 1, max_iter: int = 300, tol: float = 1e-4, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centroids and inertia of the best of ``n_init`` runs: k-means++ starts (or those given), Lloyd steps, empty clusters moved to the farthest row."""
    best = None
    norms, spread, own = (x * x).sum(1), tol * x.var(0).mean(), np.arange(k)
    for run in range(n_init):
        c = x[_start(x, norms, k, np.random.default_rng([seed, run]))] if start is None else start
        for _ in range(max_iter):
            d = (c * c).sum(1) - 2 * (x @ c.T)
            label = d.argmin(1)
            member = (label[:, None] == own).astype(x.dtype)
            count = member.sum(0)
            new = (member.T @ x) / np.maximum(count, 1)[:, None]
            if (count == 0).any():
                new[count == 0] = x[(d.min(1) + norms).argmax()]
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= spread:
                break
        label = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        inertia = float(((x - c[label]) ** 2).sum())
        if best is None or inertia < best[2]:
            best = label, c, inertia
    return best


def silhouette_cosine(x: np.ndarray, label: np.ndarray) -> float | None:
    """Mean silhouette under cosine distance from sums of unit vectors; None unless 2 to n - 1 clusters have members."""
    names, at, count = np.unique(label, return_inverse=True, return_counts=True)
    if not 2 <= len(names) < len(x):
        return None
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    total = np.zeros((len(names), x.shape[1]))
    np.add.at(total, at, u)
    far = count[None] - u @ total.T
    own = far[np.arange(len(x)), at] - (1 - (u * u).sum(1))
    a = own / np.maximum(count[at] - 1, 1)
    far = far / count[None]
    far[np.arange(len(x)), at] = np.inf
    b = far.min(1)
    s = np.where(count[at] == 1, 0.0, (b - a) / np.where(np.maximum(a, b) == 0, 1, np.maximum(a, b)))
    return float(s.mean())


def _scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit values, each turned into another."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def dropout_masks(rows: np.ndarray, step: int, widths: list[int], rate: float, seed: int) -> list[np.ndarray]:
    """A mask for each hidden layer. A row's mask follows from its number and the step alone, so it is the same wherever the row is."""
    base, out = _scrambled(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + step)), []
    for layer, width in enumerate(widths):
        u = _scrambled(base[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(layer << 40))
        out.append(((u >> np.uint64(11)) / float(1 << 53) >= rate) / (1 - rate))
    return out


class Net:
    """A dense ReLU net with one sigmoid output that AdamW trains full-batch. Losses and gradients come as sums over rows, so that parts of a document can be added up."""

    def __init__(self, dim: int, hidden=(128, 32), lr: float = 0.005, dropout: float = 0.3, seed: int = 42, decay: float = 0.01) -> None:
        rng, sizes = np.random.default_rng(seed), [dim, *hidden, 1]
        w = [rng.uniform(-1, 1, (a, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:], strict=False)]
        b = [rng.uniform(-1, 1, n) / np.sqrt(a) for a, n in zip(sizes, sizes[1:], strict=False)]
        self.params, self.hidden, self.lr, self.dropout, self.seed, self.decay, self.steps = w + b, list(hidden), lr, dropout, seed, decay, 0
        self.m, self.v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def _forward(self, z: np.ndarray, masks: list[np.ndarray] | None):
        n = len(self.hidden) + 1
        acts, on = [z], []
        for i in range(n):
            z = z @ self.params[i] + self.params[n + i]
            if i < n - 1:
                on.append((masks[i] if masks else 1.0) * (z > 0))
                z = z * on[-1]
                acts.append(z)
        return 1 / (1 + np.exp(-np.clip(z[:, 0], -60, 60))), acts, on

    @staticmethod
    def _loss(p: np.ndarray, y: np.ndarray) -> float:
        return float(-(y * np.log(p.clip(1e-12)) + (1 - y) * np.log((1 - p).clip(1e-12))).sum())

    def gradients(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of the next step, summed over these rows."""
        n = len(self.hidden) + 1
        p, acts, on = self._forward(x, dropout_masks(rows, self.steps + 1, self.hidden, self.dropout, self.seed))
        g, out = (p - y)[:, None], [None] * (2 * n)
        for i in range(n - 1, -1, -1):
            out[i], out[n + i] = acts[i].T @ g, g.sum(0)
            if i:
                g = (g @ self.params[i].T) * on[i - 1]
        return self._loss(p, y), out

    def judge(self, x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
        """Loss summed over these rows, and how many are told right."""
        p = self._forward(x, None)[0]
        return self._loss(p, y), int(((p >= 0.5) == (y >= 0.5)).sum())

    def step(self, gradients: list[np.ndarray]) -> None:
        """One step along mean gradients."""
        self.steps += 1
        for k, g in enumerate(gradients):
            self.params[k] *= 1 - self.lr * self.decay
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g**2
            self.params[k] -= self.lr * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-8)


def mlp(x, y, xv, yv, epochs=15, lr=0.005, hidden=(128, 32), dropout=0.3, seed=42, decay=0.01, rows=None):
    """Losses of each epoch (training, validation) and the final validation accuracy of a net. ``rows`` are the numbers of the training rows."""
    net, train, val = Net(x.shape[1], hidden, lr, dropout, seed, decay), [], []
    right, rows = 0, np.arange(len(x)) if rows is None else np.asarray(rows)
    for _ in range(epochs):
        loss, g = net.gradients(x, y, rows)
        train.append(loss / len(x))
        net.step([p / len(x) for p in g])
        loss, right = net.judge(xv, yv)
        val.append(loss / len(xv))
    return train, val, right / len(xv)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. A row of the table is one number: a bit is 0 where the row rises, and one sum moves all of them."""
    where: dict[str, int] = {}
    for i, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << i
    every = (1 << len(b)) - 1
    row = every
    for t in a:
        if match := where.get(t):
            u = row & match
            row = (row + u | row - u) & every
    return len(b) - row.bit_count()
