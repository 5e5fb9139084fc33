"""Vector functions on array columns. Elements are doubles before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for missing, unequally long or zero vectors."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def unit_score(c: Column) -> Column:
    """Cosine as a score between 0 and 1."""
    return (1 + c) / 2


def quantise(a: Column) -> Column:
    """Symmetric 8-bit integers; all zero for a zero vector."""
    top = F.array_max(F.transform(a, F.abs)).cast("double")
    return F.transform(a, lambda x: F.when(top > 0, F.round(x.cast("double") * 127 / top)).otherwise(0).cast("tinyint"))
