"""Target-decoy statistics, tests, normalisation and divergences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ionquill.operators.relational import top_k
from ionquill.operators.running import running, with_range

# Target and decoy


def q_values(df: DataFrame, score: str, is_target: Column, name: str = "qValue") -> DataFrame:
    """Adds each row's q-value: the least decoys-to-targets ratio among cut-offs at its score or below.

    Rows of one score share a cut-off. Ratios are at most 1, and 1 where a
    cut-off has no target.
    """
    cut = running(_fdr(df, score, is_target), score, False, minima={name: "__fdr"})
    return df.join(cut.select(score, name), score)


def _fdr(df: DataFrame, score: str, is_target: Column) -> DataFrame:
    """Distinct scores with the decoys-to-targets ratio of a cut-off there, in ranges."""
    sides = df.select(F.col(score), is_target.cast("long").alias("__t"))
    counts = sides.groupBy(score).agg(F.sum("__t").alias("__nt"), F.sum(1 - F.col("__t")).alias("__nd"))
    upto = running(with_range(counts, score), score, True, {"__ct": "__nt", "__cd": "__nd"})
    ratio = F.when(F.col("__ct") > 0, F.least(F.lit(1.0), F.col("__cd") / F.col("__ct"))).otherwise(1.0)
    return upto.select(score, "__range", ratio.alias("__fdr"))


def score_cut(df: DataFrame, score: str, is_target: Column, fdr: float) -> float | None:
    """The least score whose q-value is at most ``fdr``; None where there is none."""
    return _fdr(df, score, is_target).where(F.col("__fdr") <= fdr).agg(F.min(score)).first()[0]


def fdr_curve(df: DataFrame, q: str, cuts: list[float], inclusive: bool = False, **also: Column) -> DataFrame:
    """Number of rows below each cut-off, and of those among them for which each condition of ``also`` holds. One pass."""
    fits = lambda c: (F.col(q) <= c) if inclusive else (F.col(q) < c)
    what = {"n": F.lit(True), **also}
    row = [F.struct(F.lit(c).alias("cut"), *[F.count_if(fits(c) & w).alias(n) for n, w in what.items()]) for c in cuts]
    return df.agg(F.array(*row).alias("__rows")).select(F.explode("__rows").alias("__row")).select("__row.*")


def picked_proteins(df: DataFrame, proteins: Column, score: str, is_target: Column, decoy_mark: str = "rev_") -> DataFrame:
    """Protein-level scores: each protein's best peptide; of a protein and its decoy only the better one is kept.

    Columns ``protein``, ``is_target``, ``score``. Equal scores go to the target.
    """
    each = df.select(F.explode(proteins).alias("protein"), F.col(score).alias("score"), is_target.alias("is_target"))
    base = F.when(F.col("is_target"), F.col("protein")).otherwise(F.regexp_replace("protein", f"^{decoy_mark}", ""))
    best = each.withColumn("base", base).groupBy("base", "is_target").agg(F.max("score").alias("score"))
    return top_k(best, ["base"], 1, F.desc("score"), F.desc("is_target")).select(F.col("base").alias("protein"), "is_target", "score")


# Tests and adjustment


def bh_adjusted(df: DataFrame, p: str, name: str = "pAdjusted") -> DataFrame:
    """Adds Benjamini-Hochberg adjusted p-values; null p-values stay null and don't count."""
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    ranked = running(with_range(counts, p), p, False, {"__rank": "__n"})
    raw = ranked.select(p, "__range", (F.col(p) * total / F.col("__rank")).alias("__raw"))
    held = running(raw, p, True, minima={"__adj": "__raw"}).select(p, F.least(F.col("__adj"), F.lit(1.0)).alias(name))
    return df.join(held, p, "left")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


@F.pandas_udf(DoubleType())
def _t_p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, df in batches:
        yield pd.Series([None if pd.isna(x) or pd.isna(n) or n <= 0 else t_p_value(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")


def two_sample_t(df: DataFrame, keys: list[str], value: str, group: Column) -> DataFrame:
    """Pooled-variance t-test of two groups for each key; nulls are left out.

    ``group`` is 1 for the first and 0 for the second sample. Columns: the keys,
    ``n1``, ``n0``, ``foldChange`` (mean difference), ``t``, ``df``, ``pValue``.
    """
    g = df.withColumn("__g", group)
    of = lambda k: F.when(F.col("__g") == k, F.col(value))
    s = g.groupBy(*keys).agg(
        *[f(of(k)).alias(f"{n}{k}") for k in (1, 0) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    degrees = F.col("n1") + F.col("n0") - 2
    spread = (F.coalesce((F.col("n1") - 1) * F.col("v1"), F.lit(0.0)) + F.coalesce((F.col("n0") - 1) * F.col("v0"), F.lit(0.0))) / F.nullif(degrees, F.lit(0))
    t = (F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(spread * (1 / F.nullif(F.col("n1"), F.lit(0)) + 1 / F.nullif(F.col("n0"), F.lit(0)))), F.lit(0.0))
    out = s.select(*keys, "n1", "n0", (F.col("m1") - F.col("m0")).alias("foldChange"), t.alias("t"), degrees.alias("df"))
    return out.withColumn("pValue", _t_p(F.col("t"), F.col("df").cast("double")))


def regulation(change: Column, p: Column, least: float = 0.5, below: float = 0.05) -> Column:
    """Upregulated, Downregulated or Not significant."""
    sure = p < below
    return F.when(sure & (change >= least), "Upregulated").when(sure & (change <= -least), "Downregulated").otherwise("Not significant")


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of Fisher's exact test for the table a b / c d."""
    n, row, col = a + b + c + d, a + b, a + c
    log_choose = lambda x, k: math.lgamma(x + 1) - math.lgamma(k + 1) - math.lgamma(x - k + 1)
    whole = log_choose(n, col)
    log_p = lambda k: log_choose(row, k) + log_choose(n - row, col - k) - whole
    own = log_p(a)
    return min(1.0, sum(math.exp(x) for k in range(max(0, row + col - n), min(row, col) + 1) if (x := log_p(k)) <= own + 1e-7))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")


# Normalisation and similarity


def medians_equalised(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Adds ``value`` less its group's median plus the median of all values."""
    own = df.groupBy(group).agg(F.median(value).alias("__own"))
    every = df.agg(F.median(value)).scalar()
    return df.join(own, group).withColumn(name, F.col(value) - F.col("__own") + every).drop("__own")


def z_scores(df: DataFrame, keys: list[str], value: str, name: str = "z") -> DataFrame:
    """Adds (value - mean) / population deviation within each key; null where all values are equal."""
    own = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(own, keys).withColumn(name, (F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).drop("__m", "__s")


def pairwise_correlation(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Pearson correlation of each pair of columns over rows that have both; ``first``, ``second``, ``n``, ``r``."""
    cells = df.where(F.col(value).isNotNull()).select(F.col(row).alias("__row"), F.col(column).alias("c"), F.col(value).cast("double").alias("v"))
    other = cells.select("__row", F.col("c").alias("d"), F.col("v").alias("w"))
    pairs = cells.join(other, "__row").where(F.col("c") < F.col("d"))
    return pairs.groupBy(F.col("c").alias("first"), F.col("d").alias("second")).agg(F.count(F.lit(1)).alias("n"), F.corr("v", "w").alias("r"))


def _middle_slope(x: np.ndarray, y: np.ndarray, at_once: int = 1 << 21) -> float | None:
    """Median of the slopes of all pairs of points with different ``x``; slopes are made in blocks, not held."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    after = np.searchsorted(x, x, side="right")
    pairs = int((len(x) - after).sum())
    if not pairs:
        return None
    rows = max(1, at_once // len(x))

    def blocks() -> Iterator[np.ndarray]:
        for k in range(0, len(x), rows):
            run = x[None, k:] - x[k : k + rows, None]
            ahead = run > 0
            yield (y[None, k:] - y[k : k + rows, None])[ahead] / run[ahead]

    if pairs <= at_once:
        return float(np.median(np.concatenate(list(blocks()))))

    def ranked(nth: int) -> float:
        """The slope of rank ``nth``, from 0: 16 bits at a time of an unsigned number in the slopes' order."""
        found = 0
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16, np.int64)
            for slopes in blocks():
                bits = (slopes + 0.0).view(np.uint64)
                bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
                if shift < 48:
                    bits = bits[bits >> np.uint64(shift + 16) == np.uint64(found)]
                counts += np.bincount(((bits >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            upto = np.cumsum(counts)
            place = int(np.searchsorted(upto, nth, side="right"))
            nth -= int(upto[place] - counts[place])
            found = found << 16 | place
        found = found ^ (1 << 63) if found >> 63 else found ^ ((1 << 64) - 1)
        return float(np.uint64(found).view(np.float64))

    low = ranked((pairs - 1) // 2)
    return low if pairs % 2 else (low + ranked(pairs // 2)) / 2


def median_slopes(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Theil-Sen line of each key: median of the slopes of all pairs of points, and median of y - slope * x.

    A key's points are held by one task, its pairs made in blocks: time grows with
    the square of a key's points, memory doesn't. Columns ``slope``, ``intercept``, ``n``.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for k in keys:
        known = known.where(F.col(k).isNotNull())

    def line(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        px, py = points["x"].to_numpy(), points["y"].to_numpy()
        slope = _middle_slope(px, py)
        found = [] if slope is None else [(*key, slope, float(np.median(py - slope * px)), len(px))]
        return pd.DataFrame(found, columns=[*keys, "slope", "intercept", "n"])

    schema = StructType([*[known.schema[k] for k in keys], StructField("slope", DoubleType()), StructField("intercept", DoubleType()), StructField("n", LongType())])
    return known.groupBy(*keys).applyInPandas(line, schema)


def divergence(df: DataFrame, keys: list[str], symbol: str, is_first: Column) -> DataFrame:
    """Jensen-Shannon divergence (natural log) of two samples' symbols for each key, and each symbol's signed part of it.

    Columns: keys, symbol, ``p``, ``q``, ``part`` (positive where the first sample
    has more of it; positive parts add up to the divergence, and so do the
    magnitudes of negative ones), ``divergence``. A key that one sample lacks has
    an infinite divergence, and NaN for the parts; its shares in that sample are null.
    """
    counts = df.groupBy(*keys, symbol).agg(F.count_if(is_first).alias("a"), F.count_if(~is_first).alias("b"))
    sums = counts.groupBy(*keys).agg(F.sum("a").alias("__a"), F.sum("b").alias("__b"))
    shares = counts.join(sums, keys).select(*keys, symbol, (F.col("a") / F.nullif(F.col("__a"), F.lit(0))).alias("p"), (F.col("b") / F.nullif(F.col("__b"), F.lit(0))).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    entropy = lambda x: F.when(m.isNull(), float("inf")).when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    raw = shares.withColumns({"__left": entropy(F.col("p")), "__right": entropy(F.col("q"))}).withColumn("__way", F.col("__left") - F.col("__right"))
    more, less = F.greatest("__way", F.lit(0.0)), F.greatest(-F.col("__way"), F.lit(0.0))
    per_key = raw.groupBy(*keys).agg((F.sum(F.col("__left") + F.col("__right")) / 2).alias("divergence"), F.sum(more).alias("__more"), F.sum(less).alias("__less"))
    scale = F.when(F.col("__way") > 0, F.col("__more")).otherwise(F.col("__less"))
    part = F.when(F.isnan("__way"), float("nan")).when(F.col("__way") == 0, 0.0).otherwise(F.col("divergence") * F.col("__way") / scale)
    return raw.join(per_key, keys).select(*keys, symbol, "p", "q", part.alias("part"), "divergence")


def symbol_counts(df: DataFrame, sequence: str, keys: list[str] | None = None) -> DataFrame:
    """Count of each symbol at each position (from 0)."""
    keys = keys or []
    symbols = F.filter(F.split(F.col(sequence), ""), lambda x: x != "")
    return df.select(*keys, F.posexplode(symbols).alias("position", "symbol")).groupBy(*keys, "position", "symbol").agg(F.count(F.lit(1)).alias("n"))


def sampled(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of their key: the same rows in every run."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def fold(*key: str, folds: int = 10) -> Column:
    """Number of the fold that a row falls in, by a hash of its key."""
    return F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int")


def largest_of(window_keys: list[str], value: str) -> Column:
    """The largest value of a key on all its rows."""
    return F.max(value).over(Window.partitionBy(*window_keys))


def fold_lines(df: DataFrame, keys: list[str], x: str, y: str, own_fold: Column, folds: int = 10) -> DataFrame:
    """Theil-Sen lines of each key, one for each ``fold``, learned from the points of all other folds."""
    taught = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("__own"))
    each = df.withColumn("__own", own_fold).select(*keys, F.explode(taught).alias("fold"), x, y)
    return median_slopes(each, [*keys, "fold"], x, y)
