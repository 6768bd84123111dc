"""Running totals and minima over a whole table's order, without one task that reads it all.

Values are cut into ranges at approximate quantiles. Each range gets its own
window, and what the ranges before it hold is added to it: one number a range,
which the driver adds up. Equal values always share a range, and count as one
place in the order.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquill.functions.arrays import once

RANGES = 256


def _constant(numbers: list[float]) -> Column:
    """A constant array: one text, which is folded once, since hundreds of literals are slow to plan."""
    return F.split(F.lit(",".join(repr(float(x)) for x in numbers)), ",").cast("array<double>")


def with_range(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``__range``, which rises with ``value``."""
    at = F.split(F.lit(",".join(str(k / ranges) for k in range(1, ranges))), ",").cast("array<double>")
    bounds = df.agg(F.percentile_approx(value, at, 10_000).alias("b")).first()["b"] or []
    bounds = sorted({b for b in bounds if b is not None})
    if not bounds:
        return df.withColumn("__range", F.lit(0))
    return df.withColumn("__range", _place(bounds, F.col(value).cast("double")))


def _place(bounds: list[float], value: Column, step: int = 16) -> Column:
    """How many sorted bounds are below a value: first among every ``step``-th, then among the few after that one."""
    fine, coarse = _constant(bounds), _constant(bounds[step - 1 :: step] or [math.inf])
    below = lambda some: F.size(F.filter(some, lambda b: b < value))
    return once(below(coarse), lambda k: k * step + below(F.slice(fine, k * step + 1, F.lit(step))))


def running(df: DataFrame, value: str, descending: bool, sums: dict[str, str] | None = None, minima: dict[str, str] | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds running sums and minima of columns, from one end of the order of ``value`` up to each row and its ties.

    ``sums`` and ``minima`` give new names their columns; results are doubles.
    A table that ``with_range`` has cut already is taken as it is.
    """
    sums, minima = sums or {}, minima or {}
    cut = df if "__range" in df.columns else with_range(df, value, ranges)
    per = cut.groupBy("__range").agg(*[F.sum(c).alias(f"s_{n}") for n, c in sums.items()], *[F.min(c).alias(f"m_{n}") for n, c in minima.items()]).collect()  # at most one row a range
    held = {r["__range"]: r for r in per}
    order = sorted(held, reverse=descending)
    inside = Window.partitionBy("__range").orderBy(F.desc(value) if descending else F.asc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def before(name: str, start: float, join) -> Column:
        so_far = list(accumulate([held[k][name] for k in order], join, initial=start))[:-1]
        table = [0.0] * (max(order, default=0) + 1)
        for k, x in zip(order, so_far, strict=True):
            table[k] = x
        return F.get(_constant(table), F.col("__range"))

    least = lambda a, b: a if b is None else min(a, float(b))
    new = {n: F.sum(F.col(c).cast("double")).over(inside) + before(f"s_{n}", 0.0, lambda a, b: a + float(b or 0)) for n, c in sums.items()}
    new |= {n: F.least(F.min(F.col(c).cast("double")).over(inside), before(f"m_{n}", math.inf, least)) for n, c in minima.items()}
    return cut.select(*df.columns, *[c.alias(n) for n, c in new.items()])


def exact_quantile_nearest(df: DataFrame, value: str, q: float) -> float | None:
    """The element at place round(q * (n - 1)) of the ascending order, halves rounded up."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    n = counts.agg(F.sum("__n")).first()[0]
    if not n:
        return None
    place = int(q * (n - 1) + 0.5)
    return running(counts, value, False, {"__upto": "__n"}).where(F.col("__upto") > place).agg(F.min(value)).first()[0]


def dense_numbers(df: DataFrame, keys: list[str], name: str = "index") -> DataFrame:
    """Adds a number from 0 to each distinct key, in the keys' order; the distinct keys should be few."""
    distinct = df.select(*keys).distinct().withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    return df.join(distinct, keys)
