"""Vector functions over arrays, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Divided by the norm; a zero vector stays zero."""
    n = norm(a)
    return F.transform(doubles(a), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine_similarity(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """The cosine with ``eps`` added to each norm."""
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
