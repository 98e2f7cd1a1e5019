"""Arrays of numbers, scores and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; null for a zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def noisy_or(weights: Column) -> Column:
    """Chance that at least one of independent signs holds; a certain sign gives 1."""
    return 1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - w))


def weighted(values: list[Column], weights: list[float]) -> Column:
    """Weighted mean; weights must be non-negative with a positive sum."""
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative and sum to more than 0")
    total = sum(weights)
    out = F.lit(0.0)
    for v, w in zip(values, weights):
        out = out + v * F.lit(w / total)
    return out


def share(c: Column) -> Column:
    """A relevance as a share: per cent above 1, clamped; null, NaN and infinite are 0."""
    x = c.try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)
    return F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x)))).otherwise(0.0)
