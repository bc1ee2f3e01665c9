"""Vector arithmetic on array columns, as foldable expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    """Sum of an array in order, in double precision; 0 for an empty one."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """v / (|v| + 1e-12): the small term is added, so a zero vector stays zero. The length is computed once, not for each component."""
    return _divided(v, lambda size: size + 1e-12)


def _divided(v: Column, by: Callable[[Column], Column]) -> Column:
    """v by a number made of its length. The inner array holds the one vector, so that v and its length are values and not computed again."""
    lengthy = F.transform(F.array(v), lambda x: F.struct(x.alias("v"), by(F.sqrt(dot(x, x))).alias("by")))
    return F.get(F.transform(lengthy, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["by"])), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalized vectors."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-12) * (F.sqrt(dot(b, b)) + 1e-12))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def sum_abs_difference(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def count_differing(a: Column, b: Column) -> Column:
    """How many elements differ; null equals null."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))


def same_members(a: Column, b: Column) -> Column:
    """Whether two lists hold the same elements in whatever order."""
    return F.array_sort(a) == F.array_sort(b)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def l2_normalized_above(v: Column, least: float = 1e-12) -> Column:
    """v divided by its norm, or by least where the norm is smaller; unlike l2_normalized nothing is added to the norm."""
    return _divided(v, lambda size: F.greatest(size, F.lit(least)))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two vectors have the same length and differ by no more than tolerance anywhere; false where either is null or holds NaN."""
    gap = max_abs_difference(a, b)
    return F.coalesce((F.size(a) == F.size(b)) & ~F.isnan(gap) & (gap <= tolerance), F.lit(False))
