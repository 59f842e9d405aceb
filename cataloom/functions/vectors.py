"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; null for a zero vector."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if either vector is null or zero, or the lengths differ."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale)


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)
