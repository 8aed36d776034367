"""Expressions on ``ARRAY<DOUBLE>`` columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(*cols: str) -> Column:
    """One vector out of scalar columns."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def total(values: Column) -> Column:
    """Sum of an array, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def centre(values: Column | str, mean: Column | str) -> Column:
    """Subtract a scalar from every element."""
    shift = F.col(mean) if isinstance(mean, str) else mean
    return F.transform(values, lambda v: v - shift)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v * v)))


def sq_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(sq_distance(a, b))


def centred_cosine(
    a: Column | str, a_mean: Column | str, b: Column | str, b_mean: Column | str
) -> Column:
    """Cosine of two vectors after centring each; null when either is constant."""
    ca, cb = centre(a, a_mean), centre(b, b_mean)
    return F.try_divide(dot(ca, cb), norm(ca) * norm(cb))


def item_at(values: Column | str, index: Column | str) -> Column:
    """Element by zero-based index, null outside the array."""
    return F.get(values, index)
