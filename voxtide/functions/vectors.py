"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column, norm_b: Column, eps: float = 1e-8) -> Column:
    """1 - cosine similarity, clipped to [-1, 1]; 1 if either vector is (nearly) zero."""
    similarity = F.coalesce(dot(a, b) / F.when(norm_a * norm_b >= eps, norm_a * norm_b), F.lit(0.0))
    return F.lit(1.0) - F.least(F.greatest(similarity, F.lit(-1.0)), F.lit(1.0))
