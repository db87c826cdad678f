"""Vectors held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    """The angle as a share of pi; 1 for zero vectors or unequal lengths."""
    n = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (n > 0)
    return F.when(ok, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / n))) / F.lit(3.141592653589793)).otherwise(1.0)


def intersection_distance(a: Column, b: Column) -> Column:
    """1 less the sum of the smaller components."""
    return F.lit(1.0) - total(F.zip_with(a, b, lambda x, y: F.least(x.cast("double"), y.cast("double"))))
