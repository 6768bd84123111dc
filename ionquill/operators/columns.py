"""Projections across columns, value maps and small models of retention time and score."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquill.constants import RESIDUE_MASS


def replaced(column: Column, values: dict) -> Column:
    """The value that the map has for a column's value; values that it lacks pass through."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), column)


def across(columns: list[str], what: str) -> Column:
    """min, max, sum, mean or count over columns of one row; nulls are left out."""
    held = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda s, x: s + x)
    some = F.size(held) > 0
    return {"min": F.array_min(held), "max": F.array_max(held), "sum": total, "count": F.size(held), "mean": F.when(some, total / F.size(held))}[what]


def filled_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of text columns as empty strings."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def spectrum_index(spectra: DataFrame) -> DataFrame:
    """Adds ``index``, a spectrum's place (from 0) in its file by scan number."""
    return spectra.withColumn("index", F.row_number().over(Window.partitionBy("source").orderBy("scan")).cast("long") - 1)


def modification_strings(encoded: Column) -> tuple[Column, Column]:
    """Numbered and ``@`` forms of an encoded sequence's modifications: oxidised methionine (21) and every cysteine (2)."""
    named = F.filter(
        F.transform(encoded, lambda x, i: F.struct((i + 1).alias("at"), F.when(x == 2, "C").when(x == 21, "M").alias("r"), F.when(x == 2, "Carbamidomethyl").when(x == 21, "Oxidation").alias("name"))),
        lambda m: m["r"].isNotNull(),
    )
    # the numbered form counts from the residue after, as its readers expect
    numbered = F.array_join(F.transform(named, lambda m: F.concat(F.lit("/"), (m["at"] + 1).cast("string"), F.lit(","), m["r"], F.lit(","), m["name"])), "")
    marked = F.array_join(F.transform(named, lambda m: F.concat(m["name"], F.lit("@"), m["r"], (m["at"] + 1).cast("string"))), "; ")
    return F.concat(F.size(named).cast("string"), numbered), marked


def metric(label: Column, angle: Column, score: Column, angle_cut: float, score_cut: float) -> Column:
    """1 for sure targets, -1 for other targets, 0 for decoys."""
    return F.when((label > 0) & (angle > angle_cut) & (score > score_cut), 1).when(label > 0, -1).otherwise(0)


def fitted_times(df: DataFrame, sequence: str = "peptide", time: str = "retentionTime", train: Column | None = None, name: str = "predictedRT") -> DataFrame:
    """Adds a retention time from residue counts and log length by a linear model, learned from the rows of ``train``."""
    residues = sorted(RESIDUE_MASS)
    counts = {f"__n_{r}": F.regexp_count(F.col(sequence), F.lit(r)).cast("double") for r in residues} | {"__log_n": F.ln(F.length(sequence))}
    wide = df.withColumns(counts)
    data = VectorAssembler(inputCols=list(counts), outputCol="__x").transform(wide)
    chosen = data if train is None else data.where(train)
    model = LinearRegression(featuresCol="__x", labelCol=time, predictionCol=name, regParam=1e-3).fit(chosen.where(F.col(time).isNotNull()))
    return model.transform(data).drop("__x", *counts)


def score_regression(known: DataFrame, others: DataFrame, inputs: list[str], target: str = "engineScore") -> DataFrame:
    """``others`` with ``target`` as a robust linear function of ``inputs``, learned from ``known``."""
    assembler = VectorAssembler(inputCols=inputs, outputCol="__x")
    model = LinearRegression(featuresCol="__x", labelCol=target, predictionCol="__y", loss="huber", maxIter=100).fit(assembler.transform(known))
    return model.transform(assembler.transform(others.drop(target))).withColumnRenamed("__y", target).drop("__x")


def hierarchy(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Average-linkage clustering of a small distance matrix: merges (a, b, height), new clusters numbered after the rows."""
    n = len(distance)
    d = {(a, b): float(distance[a, b]) for a in range(n) for b in range(a)}
    size, alive, out = dict.fromkeys(range(n), 1), set(range(n)), []
    far = lambda a, b: d[max(a, b), min(a, b)]
    while len(alive) > 1:
        height, a, b = min((far(a, b), b, a) for a in alive for b in alive if b < a)
        new = n + len(out)
        alive -= {a, b}
        for c in alive:
            d[new, c] = (size[a] * far(a, c) + size[b] * far(b, c)) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        alive.add(new)
        out.append((a, b, height))
    return out
