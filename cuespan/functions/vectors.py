"""Column arithmetic on ``array<float|double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    norm = F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(as_double(v), lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def mean(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference; null when either vector is missing or the sizes differ."""
    gaps = F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y))
    return F.when(F.size(a) == F.size(b), F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: (x + y) / 2.0)


def micro_text(v: Column) -> Column:
    """The vector in whole millionths, as comma-joined text (a stable form for comparison)."""
    return F.array_join(F.transform(as_double(v), lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",")
