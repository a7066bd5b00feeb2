"""Vector expressions over arrays of numbers; elements are widened to double before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalised(v: Column, least: float = 1e-12) -> Column:
    """v over its L2 norm; a norm below the least counts as that."""
    return F.transform(doubles(v), lambda x: x / F.greatest(norm(v), F.lit(least)))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the state vectors whose mask is set: arrays of vectors and of 0 and 1."""
    masked = F.zip_with(states, mask, lambda v, m: F.transform(doubles(v), lambda x: x * m))
    total = F.aggregate(F.slice(masked, 2, F.size(masked)), F.element_at(masked, 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / count)
