"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markwise import fixed_values as fixed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero or missing."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def rounded(vector: Column, decimals: int = fixed.EMBEDDING_DECIMALS) -> Column:
    return F.transform(vector, lambda x: F.round(x, decimals))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
