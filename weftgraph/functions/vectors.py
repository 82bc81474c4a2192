"""Vector expressions over ``array<double>`` columns (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.settings import AlignSettings


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None,
           norm_b: Column | None = None, exponent: float = 1.0) -> Column:
    """Cosine clamped at 0, raised to ``exponent``; a zero vector gives 0.

    Pass precomputed norms when one vector takes part in many pairs.
    """
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    clamped = F.greatest(F.coalesce(dot(a, b) / F.nullif(length, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return clamped if exponent == 1.0 else F.pow(clamped, F.lit(exponent))


def sigmoid_skew(x: Column, settings: AlignSettings = AlignSettings()) -> Column:
    """Shifted, compressed logistic curve of a similarity."""
    shifted = (F.lit(settings.skew_x) - x) * F.lit(settings.skew_compress)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(shifted)) + F.lit(settings.skew_y)


def sentence_skew(sim: Column, settings: AlignSettings = AlignSettings()) -> Column:
    slope = settings.sentence_dampen
    return sim * F.lit(slope) + F.lit(1.0 - slope)


def clamp_unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def scale(vec: Column, factor: float | Column) -> Column:
    f = F.lit(float(factor)) if isinstance(factor, (int, float)) else factor
    return F.transform(vec, lambda x: x * f)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def add_present(*vectors: Column) -> Column:
    """Sum of the vectors that are not null; null when none is present."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.when(total.isNull(), v).when(v.isNull(), total).otherwise(add(total, v))
    return total


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def ones(dim: int) -> Column:
    return F.array_repeat(F.lit(1.0), dim)


def vector_sum(vec: str | Column, dim: int) -> Column:
    """Aggregate: component-wise sum.

    One ``sum`` per component, so partial sums are built before the shuffle and
    no group of vectors is ever collected.
    """
    c = F.col(vec) if isinstance(vec, str) else vec
    return F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(dim)])


def vector_mean(vec: str | Column, dim: int) -> Column:
    """Aggregate: component-wise mean, pre-aggregated like ``vector_sum``."""
    c = F.col(vec) if isinstance(vec, str) else vec
    return F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(dim)])


def mean_of_array(vectors: Column) -> Column:
    """Mean of an ``array<array<double>>`` that is already in one row."""
    total = F.aggregate(
        F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))),
        F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))
