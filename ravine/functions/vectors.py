"""Dense vectors as arrays: expressions inside the JVM, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays of doubles of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """V1: 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalized(v: Column) -> Column:
    """V6: unit length; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def matryoshka(v: Column, dims: int) -> Column:
    """V7: the first dims components at unit length; a shorter vector is only normalised."""
    return normalized(F.slice(v, 1, dims))


def truncated_if_longer(v: Column, dims: int) -> Column:
    """The first dims components at unit length; a vector that is not longer stays as it is."""
    return F.when(F.size(v) > dims, matryoshka(v, dims)).otherwise(v)


def truncated_after(v: Column, dims: int) -> Column:
    """Normalised first and then cut, so shorter than unit length."""
    return F.slice(normalized(v), 1, dims)
