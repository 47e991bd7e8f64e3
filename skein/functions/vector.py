"""Distances between dense vectors, on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(vector: Column, query: Sequence[float] | Column) -> Column:
    """1 - cosine; null for null and all-zero vectors."""
    if isinstance(query, Column):
        return F.lit(1.0) - F.try_divide(dot(vector, query), norm(vector) * norm(query))
    values = [float(x) for x in query]
    size = sum(x * x for x in values) ** 0.5
    return F.lit(1.0) - F.try_divide(dot(vector, F.array(*map(F.lit, values))), norm(vector) * F.lit(size))
