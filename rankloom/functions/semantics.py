"""Expressions with the edge rules of the score statistics spelled out: ties, constants, missing values, rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Ordinal levels and their weights.
LEVELS = {"absent": 0.0, "weak": 0.25, "medium": 0.5, "strong": 0.75, "dominant": 1.0}


def average_rank(value: Column | str, *by: str) -> Column:
    """0-based rank in the group ``by``; ties share the mean of their ranks."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(W.partitionBy(*by).orderBy(v)) - 1 + (F.count(F.lit(1)).over(W.partitionBy(*by, v)) - 1) / 2


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation, null if either side is constant (never a division error)."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def cosine(dot: Column, square_a: Column, square_b: Column) -> Column:
    """0.0 for a zero vector."""
    return F.coalesce(F.try_divide(dot, F.nullif(F.sqrt(square_a) * F.sqrt(square_b), F.lit(0.0))), F.lit(0.0))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers of the same length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return cosine(dot(a, b), dot(a, a), dot(b, b))


def half_up_tenth(c: Column) -> Column:
    """One decimal, halves towards plus infinity."""
    return F.floor(c * 10 + 0.5) / 10


def level_weight(c: Column) -> Column:
    """Weight of an ordinal level in whatever case; anything else is absent."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.lower(F.trim(c))), F.lit(0.0))


# Least weights of the levels.
def weight_level(c: Column) -> Column:
    return F.when(c >= 0.875, "dominant").when(c >= 0.625, "strong").when(c >= 0.375, "medium").when(c >= 0.125, "weak").otherwise("absent")


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Within bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def any_of(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, cs)
