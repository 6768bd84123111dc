"""Expressions over array columns: vector algebra, correlation, quantiles. All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: (x * x).cast("double"))))


def unit(a: Column) -> Column:
    """The array over its length; unchanged where that is zero."""
    return once(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def spectral_angle(a: Column, b: Column) -> Column:
    """1 - 2 acos(cosine) / pi, the cosine held to -1 ... 1; 0 where either array is zero."""
    # greatest and least skip nulls, so a zero length has to be kept out before
    held = lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    return once(norm(a) * norm(b), lambda n: F.when(n > 0, 1 - 2 * F.acos(held(dot(a, b) / n)) / math.pi).otherwise(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; null where either is constant."""

    def of(ma: Column, mb: Column) -> Column:
        da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
        return dot(da, db) / F.nullif(norm(da) * norm(db), F.lit(0.0))

    return once(mean(a), lambda ma: once(mean(b), lambda mb: of(ma, mb)))


def average_ranks(a: Column) -> Column:
    """Ranks from 1; ties share the mean of theirs."""
    count = lambda keep: F.size(F.filter(a, keep))
    return F.transform(a, lambda x: count(lambda y: y < x) + (count(lambda y: y == x) + 1) / 2)


def spearman(a: Column, b: Column) -> Column:
    return pearson(average_ranks(a), average_ranks(b))


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between the two nearest elements; null for an empty array."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        below, above = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
        return below + (above - below) * (at - low)

    return once(F.array_sort(a), of)


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def median_absolute_error(a: Column, b: Column) -> Column:
    return median(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def sample_variance(a: Column) -> Column:
    """Two passes, so that large values don't cancel; null below two elements."""
    return once(mean(a), lambda m: F.when(F.size(a) > 1, total(F.transform(a, lambda x: (x - m) * (x - m))) / (F.size(a) - 1)))


def running_sum(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: total(F.slice(a, F.lit(1), i)))


def nearest(values: Column, target: Column) -> Column:
    """Struct of the least ``distance`` to ``target`` and the ``index`` (from 0) of the first value at it."""
    away = F.transform(values, lambda v, i: F.struct(F.abs(v - target).alias("distance"), i.alias("index")))
    return F.array_min(away)


def as_map(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def lookup(table: dict, key: Column, kind: str = "double") -> Column:
    """The value that a small constant table has for ``key``; null where it has none."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key).cast(kind)
