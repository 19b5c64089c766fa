"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; a zero vector gives 0, other lengths fail."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, 0.0).otherwise(F.try_divide(dot(a, b), norm))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(F.raise_error(F.lit("vectors of different lengths")))
