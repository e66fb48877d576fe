"""Vectors in array columns: products, distances and the similarity of sets of vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed as doubles from first to last; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: inside a lambda it would else be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_vector(a: Column) -> Column:
    """``a`` at length 1; a zero vector stays."""
    scaled = lambda x, length: F.when(length > 0, F.transform(x, lambda v: v.cast("double") / length)).otherwise(x.cast("array<double>"))
    return bound(a, lambda x: bound(norm(x), lambda length: scaled(x, length)))


def cosine(a: Column, b: Column, missing: float | None = -1.0) -> Column:
    """Cosine; ``missing`` where a vector is null, of another length or zero. Linkers take -1, trackers 0 there."""
    value = dot(a, b) / (norm(a) * norm(b))
    known = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(known, value).otherwise(F.lit(missing))


def mean_of_top(values: Column, k: int) -> Column:
    """Mean of the ``k`` largest of an array, of all if it has fewer, -1 of none."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.when(F.size(values) > 0, F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / F.size(top)).otherwise(-1.0)


def top_similarity(left: Column, right: Column, k: int = 6) -> Column:
    """Mean of the ``k`` best of all products between two sets of unit vectors."""
    return mean_of_top(F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: dot(a, b)))), k)


def top_of_best(left: Column, right: Column, k: int = 6) -> Column:
    """Each vector of ``left`` with its best of ``right``; mean of the ``k`` best of these."""
    return mean_of_top(F.transform(left, lambda a: F.array_max(F.transform(right, lambda b: dot(a, b)))), k)


def ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger of two sizes, 0 if one is not positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def trust(age: Column, rate: float = 0.004, long_rate: float = 0.002, long_after: float = 240.0, floor: float = 0.02, cap: float = 0.06) -> Column:
    """Trust in an identity not seen for ``age`` frames: exponential decay, faster after a long time, times ``cap`` and not below ``floor``."""
    late = F.greatest(age - long_after, F.lit(0.0))
    return F.greatest(F.lit(floor), F.lit(cap) * F.exp(-rate * age - long_rate * late))


def fused(parts: list[Column], weights: list[float]) -> Column:
    """Several vectors as one: each at length 1 and times its weight, one after the other, and the whole at length 1 again."""
    times = lambda weight: lambda v: v * weight
    return unit_vector(F.concat(*[F.transform(unit_vector(p), times(w)) for p, w in zip(parts, weights)]))
