"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size))
