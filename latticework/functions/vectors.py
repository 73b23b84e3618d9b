"""Vector functions on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def l2(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def abs_cosine(x: Column, y: Column) -> Column:
    """Absolute cosine; 1 for two zero vectors, 0 for one."""
    both, one = (norm(x) == 0) & (norm(y) == 0), (norm(x) == 0) | (norm(y) == 0)
    return F.when(both, 1.0).when(one, 0.0).otherwise(F.abs(dot(x, y)) / (norm(x) * norm(y)))


def affinity(x: Column, y: Column) -> Column:
    """(x.y)^2 / (|x|^2 |y|^2); null where it is not a number."""
    below = dot(x, x) * dot(y, y)
    return F.when(below != 0, dot(x, y) * dot(x, y) / below)
