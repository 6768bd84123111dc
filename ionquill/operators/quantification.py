"""Label-free quantities: cleaning, normalising, comparing samples. Tables are long: one row for each peptide and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.operators.relational import top_one
from ionquill.operators.statistics import bh_adjusted, medians_equalised, regulation, two_sample_t


def quant_value(area: Column, background: Column) -> tuple[Column, Column]:
    """Area above background (not below 0), and the area's share of both."""
    return F.greatest(area - background, F.lit(0.0)), area / F.nullif(area + background, F.lit(0.0))


def valid_log2(raw: Column, ratio: Column, idp: Column, least_idp: float = 0.5, least_ratio: float = 0.8) -> Column:
    """log2 of quantities that pass both cut-offs; null for the rest."""
    return F.when((idp > least_idp) & (ratio > least_ratio), F.log2(F.nullif(raw, F.lit(0.0))))


def formatted(report: DataFrame) -> DataFrame:
    """Skyline report rows as ``peptide``, ``source``, ``raw``, ``idp``, ``ratio``; the largest area of each peptide and file.

    An isotope dot product of 0, or none, counts as 1.
    """
    raw, ratio = quant_value(F.col("TotalAreaMs1").cast("double"), F.col("TotalBackgroundMs1").cast("double"))
    idp = F.coalesce(F.nullif(F.col("IsotopeDotProduct").try_cast("double"), F.lit(0.0)), F.lit(1.0))
    rows = report.select(
        F.col("PeptideSequence").alias("peptide"), F.regexp_replace("FileName", r"\.(mzML|raw|mgf)$", "").alias("source"),
        F.coalesce(raw, F.lit(0.0)).alias("raw"), idp.alias("idp"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"),
    )
    return top_one(rows, ["source", "peptide"], F.desc("raw"), F.desc("idp"), F.desc("ratio"))


def normalised(long: DataFrame) -> DataFrame:
    """Adds ``clean`` (log2 of valid quantities) and ``norm`` (file medians made equal)."""
    clean = long.withColumn("clean", valid_log2(F.col("raw"), F.col("ratio"), F.col("idp")))
    return medians_equalised(clean, "source", "clean", "norm")


def sample_means(long: DataFrame, samples: DataFrame, value: str = "norm") -> DataFrame:
    """Mean over each sample's files; ``samples`` maps ``source`` to ``sample`` and ``isInfected``."""
    return long.join(samples, "source").groupBy("peptide", "sample", "isInfected").agg(F.avg(value).alias("value"))


def compared(means: DataFrame) -> DataFrame:
    """Fold change, p-value, adjusted p-value and class of every peptide, infected against control."""
    tested = two_sample_t(means, ["peptide"], "value", F.col("isInfected").cast("int"))
    return bh_adjusted(tested, "pValue").withColumn("regulation", regulation(F.col("foldChange"), F.col("pValue")))


def wide(long: DataFrame, values: list[str], sources: list[str]) -> DataFrame:
    """One row for each peptide, a column ``<source>_<value>`` for each file and value."""
    first = [F.first(v, ignorenulls=True).alias(v) for v in values]
    return long.groupBy("peptide").pivot("source", sources).agg(*first) if len(values) > 1 else long.groupBy("peptide").pivot("source", sources).agg(first[0]).withColumnsRenamed({s: f"{s}_{values[0]}" for s in sources})


def identified(psms: DataFrame, sources: list[str]) -> DataFrame:
    """0/1 columns ``<source>_identified`` for each peptide."""
    found = [F.max((F.col("source") == s).cast("int")).alias(f"{s}_identified") for s in sources]
    return psms.groupBy("peptide").agg(*found)


def n_valid(long: DataFrame, least_idp: float = 0.5, least_ratio: float = 0.8) -> DataFrame:
    """How many files have a valid quantity of each peptide."""
    fine = (F.col("idp") > least_idp) & (F.col("ratio") > least_ratio) & (F.col("raw") > 0)
    return long.groupBy("peptide").agg(F.count_if(fine).alias("nValid"))
