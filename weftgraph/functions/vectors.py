"""Vector column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """V1: cosine with ``epsilon`` added to the denominator (1e-8, 1e-10 or 0)."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def cosine_unit(a: Column, b: Column) -> Column:
    """V1: cosine clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
