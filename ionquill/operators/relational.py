"""Joins, group filters and row choices that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should be total for a stable result."""
    return top_k(df, keys, 1, *order)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key; Spark keeps k rows a key before it shuffles."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= k).drop("__nth")


def batched(df: DataFrame, keys: list[str], size: int, *order: Column, name: str = "batch") -> DataFrame:
    """Numbers rows of each key in batches of ``size``, from 0."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.floor((nth - 1) / size).cast("int"))


def second_best_gap(df: DataFrame, keys: list[str], score: str, name: str = "deltaScore") -> DataFrame:
    """Adds each row's score less the second best of its key; a key with one row counts 0 as second."""
    whole = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.col(score) - F.coalesce(F.nth_value(score, 2).over(whole), F.lit(0)))


def tolerance_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Pairs whose values differ by at most ``tolerance``, and agree on ``keys``.

    Values fall in bins as wide as the tolerance; the right side is dealt to its
    own bin and both neighbours, so the join is an equi-join, each pair is met
    once, and the exact condition is checked after it.
    """
    keys = keys or []
    bin_of = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    near = right.where(F.col(right_value).isNotNull()).withColumn("__bin", F.explode(F.array(*[bin_of(right_value) + d for d in (-1, 0, 1)])))
    own = left.withColumn("__bin", bin_of(left_value)).alias("l")
    near = near.alias("r")
    fits = F.col("l.__bin") == F.col("r.__bin")
    for k in keys:
        fits &= F.col(f"l.{k}") == F.col(f"r.{k}")
    fits &= F.abs(F.col(f"l.{left_value}") - F.col(f"r.{right_value}")) <= tolerance
    columns = [F.col(f"l.{c}") for c in left.columns]
    if how not in ("left_semi", "left_anti"):
        columns += [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return own.join(near, fits, how).select(*columns)


def nearest_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, left_id: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each left row with the nearest right row within ``tolerance``; the smaller right value wins a tie. Rows without one are left out."""
    pairs = tolerance_join(left, right, left_value, right_value, tolerance, keys)
    return top_one(pairs, left_id, F.abs(F.col(left_value) - F.col(right_value)), F.col(right_value))


def substring_join(needles: DataFrame, hays: DataFrame, needle: str, hay: str, k: int, needle_id: str, hay_id: str) -> DataFrame:
    """Pairs (``needle_id``, ``hay_id``, ``position`` from 1) where the needle occurs in the hay; its first place counts.

    The needle's first ``k`` characters, or all of a shorter one, are looked up
    among all runs of as many characters of the hays (an equi-join on hashes), and
    the few candidates are compared in full. Empty needles are not found.
    """
    size = F.least(F.length(needle), F.lit(k))
    heads = needles.where(F.length(needle) > 0).select(F.col(needle_id), F.col(needle).alias("__needle"), size.alias("__size"), F.xxhash64(F.substring(F.col(needle), F.lit(1), size)).alias("__run"))
    # at most k different sizes; a look-ahead meets the run at every place in one pass, substring would count from the start each time
    sizes = sorted(r["__size"] for r in heads.select("__size").distinct().collect()) or [k]
    hashes = lambda n: F.array_distinct(F.transform(F.regexp_extract_all(F.col(hay), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda r: F.xxhash64(r)))
    runs = lambda n: F.transform(hashes(n), lambda r: F.struct(F.lit(n).alias("n"), r.alias("run")))
    exploded = hays.select(F.col(hay_id), F.explode(F.concat(*map(runs, sizes))).alias("__r")).select(hay_id, F.col("__r.n").alias("__size"), F.col("__r.run").alias("__run"))
    candidates = exploded.join(heads, ["__size", "__run"]).select(hay_id, needle_id, "__needle")
    found = candidates.join(hays.select(hay_id, F.col(hay).alias("__hay")), hay_id)
    position = F.instr(F.col("__hay"), F.col("__needle"))
    return found.select(needle_id, hay_id, position.alias("position")).where(F.col("position") > 0)


def outer_with_indicator(left: DataFrame, right: DataFrame, keys: list[str], name: str = "side") -> DataFrame:
    """Full outer join; ``name`` tells whether a row comes from ``both``, ``left_only`` or ``right_only``."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), keys, "full")
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return joined.withColumn(name, side).drop("__l", "__r")


def without_flagged_best(df: DataFrame, keys: list[str], weight: Column, flagged: Column) -> DataFrame:
    """Drops every row of a key whose highest-weighted rows include a flagged one."""
    ranked = df.withColumns({"__w": weight, "__f": flagged})
    best = ranked.groupBy(*keys).agg(F.max_by(F.struct("__f"), F.struct(F.col("__w"), F.col("__f").cast("int"))).alias("b"))
    bad = best.where(F.col("b.__f")).select(*keys)
    return df.join(bad, keys, "left_anti")


def without_controls(df: DataFrame, keys: list[str], control: Column) -> DataFrame:
    """Drops every key that any control row has."""
    return df.join(df.where(control).select(*keys).distinct(), keys, "left_anti")


def group_transform(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Adds each key's aggregates to all its rows, through an aggregate and a join, so that hot keys are pre-aggregated."""
    own = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(own, keys)


def union_aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, with the first table's columns and types; columns that others lack are null."""
    out = first
    for other in others:
        held = {f.name for f in other.schema}
        cells = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in held else F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema]
        out = out.unionByName(other.select(*cells))
    return out


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and the others, those of which it is unknown included."""
    sure = F.coalesce(condition, F.lit(False))
    return df.where(sure), df.where(~sure)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def isobaric_join(peptides: DataFrame, others: DataFrame, mass: str, places: int = 2) -> DataFrame:
    """Pairs of equal mass after rounding."""
    key = lambda df: df.withColumn("__mass", F.round(F.col(mass), places))
    return key(peptides).alias("l").join(key(others.withColumnsRenamed({c: f"other_{c}" for c in others.columns if c != mass})).drop(mass), "__mass").drop("__mass")


def isobaric_counts(peptides: DataFrame, key: str, mass: str, places: int = 2, name: str = "n_isobaric") -> DataFrame:
    """For each key the number of pairs that its rows make with rows of other keys of equal mass after rounding; keys without any are left out.

    Rows are counted by mass and key, and each such class meets the count of its
    whole mass by ``isobaric_join``, so no pairs of rows are formed.
    """
    own = peptides.where(F.col(key).isNotNull()).select(key, F.round(F.col(mass), places).alias("__mw")).groupBy("__mw", key).agg(F.count(F.lit(1)).alias("__n"))
    met = isobaric_join(own, own.groupBy("__mw").agg(F.sum("__n").alias("__n")), "__mw", places)
    return met.groupBy(key).agg(F.sum(F.col("__n") * (F.col("other___n") - F.col("__n"))).alias(name)).where(F.col(name) > 0)


def sub_sequences(df: DataFrame, sequence: str, low: int, high: int, name: str = "part") -> DataFrame:
    """One row for each run of ``low`` to ``high`` residues."""
    n = F.length(sequence)
    sized = df.withColumn("__len", F.explode(F.sequence(F.lit(low), F.least(F.greatest(n, F.lit(low)), F.lit(high))))).where(F.col("__len") <= n)
    placed = sized.withColumn("__at", F.explode(F.sequence(F.lit(1), n - F.col("__len") + 1)))
    return placed.withColumn(name, F.substring(F.col(sequence), F.col("__at"), F.col("__len"))).drop("__len", "__at")
