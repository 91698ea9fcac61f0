"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def same_length(a: Column, b: Column) -> Column:
    """a, or an error where the lengths differ."""
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors of different length")).cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Higher is nearer: cosine, dot, or 1 / (1 + distance)."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return 1 / (1 + euclidean(a, b))
    raise ValueError(f"no such metric: {metric}")
