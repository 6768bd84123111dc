"""Columns of the feature table that need more than one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.constants import RESIDUE_MASS
from ionquill.functions import peptides as P
from ionquill.functions.arrays import total
from ionquill.operators.running import dense_numbers


def unique_scan(df: DataFrame, source: str = "source", scan: str = "scan", name: str = "scannr") -> DataFrame:
    """Adds a number for each (source, scan): index of the source, in order of names, times the largest scan, plus the scan."""
    most = df.agg(F.max(scan)).scalar()
    return dense_numbers(df, [source], "__file").withColumn(name, F.col("__file") * most + F.col(scan)).drop("__file")


def imputed(df: DataFrame, source: str, columns: list[str], sentinel: float = -1.0) -> DataFrame:
    """Sentinel values replaced by their file's median of the values above it; they stay where there are none."""
    medians = df.groupBy(source).agg(*[F.median(F.when(F.col(c) > sentinel, F.col(c))).alias(f"__m_{c}") for c in columns])
    joined = df.join(medians, source)
    new = {c: F.when(F.col(c) == sentinel, F.coalesce(f"__m_{c}", F.lit(sentinel))).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).drop(*[f"__m_{c}" for c in columns])


def informative(df: DataFrame, columns: list[str], excluded: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold at least two values and aren't excluded; one pass over the table."""
    own = [c for c in columns if c not in excluded]
    if not own:
        return []
    row = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in own]).first()
    return [c for c in own if row[c]]


def basic_features(psms: DataFrame, masses: dict[int, float], variable: str = "", legacy_mass: bool = False) -> DataFrame:
    """Adds the features that a PSM's own sequence gives.

    ``variable`` holds the ids of variable modifications. ``legacy_mass`` leaves
    modification masses out of the mean residue mass.
    """
    s, code = F.col("peptide"), F.col("ptm_seq")
    mean = psms.agg(F.avg(F.length("peptide"))).scalar()
    own = P.residue_masses(s, code if not legacy_mass else F.lit(None).cast("string"), {} if legacy_mass else masses)
    return psms.withColumns({
        "sequenceLength": F.length(s), "seqLenMeanDiff": F.abs(F.length(s) - mean), "absMassDiff": F.abs("massDiff"), "nVarMods": P.n_variable(code, variable),
        "avgResidueMass": total(own) / F.length(s), "nRepeatedResidues": P.n_repeated(s), "fracUnique": P.fraction_unique(s),
        "fracC": P.fraction_cysteine(s), "fracKR": P.fraction_basic(s),
    })


def known_residues(sequence: Column) -> Column:
    return sequence.rlike(f"^[{''.join(RESIDUE_MASS)}]+$")


def delta_rt(df: DataFrame, fits: DataFrame, source: str = "source", fold: str | None = None) -> DataFrame:
    """Adds ``deltaRT``: how far the observed time is from the file's line, in units of its predictor.

    ``fits`` has ``slope`` and ``intercept`` of files, or of files and folds. A row
    takes its own fold's line, if ``fold`` names one, else the mean of its file's;
    rows of files without lines take the mean of all, and 0 where there are none.
    """
    mean_slope, mean_intercept = fits.agg(F.avg("slope")).scalar(), fits.agg(F.avg("intercept")).scalar()
    own = fits.groupBy(source).agg(F.avg("slope").alias("slope"), F.avg("intercept").alias("intercept"))
    joined = df.join(own, source, "left")
    slope, intercept = F.coalesce(F.col("slope"), mean_slope), F.coalesce(F.col("intercept"), mean_intercept)
    if fold is not None:
        joined = joined.join(fits.select(source, F.col("fold").alias(fold), F.col("slope").alias("__slope"), F.col("intercept").alias("__intercept")), [source, fold], "left")
        slope, intercept = F.coalesce("__slope", slope), F.coalesce("__intercept", intercept)
    off = F.abs((slope * F.col("iRT") + intercept - F.col("retentionTime")) / F.nullif(slope, F.lit(0.0)))
    return joined.withColumn("deltaRT", F.coalesce(off, F.lit(0.0))).drop("slope", "intercept", "__slope", "__intercept")
