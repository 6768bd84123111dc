"""The core plan: PSMs, spectra and predictions in, scored identifications out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.constants import STANDARD_MODIFICATIONS
from ionquill.functions import peptides as P
from ionquill.operators import features as X
from ionquill.operators import spectra
from ionquill.operators.columns import fitted_times
from ionquill.operators.calibration import calibrated, calibration_rows, with_settings
from ionquill.operators.proteome import with_proteins
from ionquill.operators.relational import top_one
from ionquill.operators.rescoring import rescored
from ionquill.operators.statistics import fdr_curve, fold, fold_lines, q_values
from ionquill.sources.tables import best_binding, log_affinity

# Names of the features that need no spectrum.
BASIC = ["massDiff", "sequenceLength", "engineScore", "deltaScore", "charge", "nVarMods", "missedCleavages", "avgResidueMass", "nRepeatedResidues", "fracUnique", "fracKR", "fracC", "fromChimera", "seqLenMeanDiff", "absMassDiff"]
#: Columns in which -1 means that there was nothing to measure.
SENTINELS = ["pearsonR"]


@dataclass(frozen=True)
class Options:
    """What a run of the plan may choose; ``unknown`` and ``variable`` hold modification ids as characters."""

    match: spectra.Settings
    unknown: str = ""
    variable: str = "23456789"
    without_cysteine: bool = False
    minimal: bool = False
    fdr: float = 0.01
    rounds: int = 10
    folds: int = 3
    excluded: tuple[str, ...] = ()


def default_options(**own) -> Options:
    return Options(spectra.Settings(STANDARD_MODIFICATIONS), **own)


def eligible(psms: DataFrame, options: Options) -> DataFrame:
    """PSMs without unsupported modifications, and without bare cysteines if so chosen."""
    out = psms.where(~P.has_digit(F.col("ptm_seq"), options.unknown)) if options.unknown else psms
    return out.where(~F.contains("peptide", F.lit("C"))) if options.without_cysteine else out


def joined(psms: DataFrame, scans: DataFrame, predictions: DataFrame, oxidation: str = "2", energy: str | None = None) -> DataFrame:
    """PSMs with their spectrum and prediction.

    Both joins are equi-joins on narrow keys, first the prediction (which drops
    PSMs that can't be scored), then the spectrum. ``energy`` names a column of the
    PSMs that the prediction's collision energy has to equal.
    """
    keys = ["modified_sequence", "charge"] + (["collisionEnergy"] if energy else [])
    p = psms.withColumn("modified_sequence", P.predictor_sequence(F.col("peptide"), F.col("ptm_seq"), oxidation))
    if energy:
        p = p.withColumn("collisionEnergy", F.col(energy).cast("double"))
    known = top_one(predictions.drop("peptide"), keys, F.desc("iRT"), F.desc(F.size("ions"))).withColumnsRenamed({"intensities": "predicted"})
    if not energy:
        p = p.drop("collisionEnergy")
    spectra_only = scans.select("source", "scan", "mzs", "intensities", *[F.col(c).alias(f"scan_{c}") for c in ("retentionTime", "ms1Intensity") if c in scans.columns])
    out = p.join(known, keys).join(spectra_only, ["source", "scan"])
    if "scan_retentionTime" in out.columns:
        out = out.withColumn("retentionTime", F.coalesce("retentionTime", "scan_retentionTime"))
    if "scan_ms1Intensity" in out.columns:
        out = out.withColumnRenamed("scan_ms1Intensity", "ms1Intensity")
    return out.drop("scan_retentionTime")


def calibrate(psms: DataFrame, scans: DataFrame, predictions: DataFrame, options: Options, per_file: bool = True) -> DataFrame:
    """Collision energy of each source (or one for all): the one whose predictions fit best."""
    chosen = calibration_rows(psms, ~P.has_digit(F.col("ptm_seq"), options.unknown) if options.unknown else F.lit(True), per="source" if per_file else None)
    grid = with_settings(chosen, name="__ce")
    met = joined(grid, scans, predictions, options.match.oxidation, "__ce")
    scored = spectra.spectral_features(met.select("source", "scan", "peptide", "ptm_seq", "charge", "collisionEnergy", "mzs", "intensities", "ions", "predicted"), options.match, minimal=True)
    return calibrated(scored, per_file)


def feature_table(psms: DataFrame, scans: DataFrame, predictions: DataFrame, options: Options, binding: DataFrame | None = None, delta_model=None) -> tuple[DataFrame, list[str]]:
    """The feature table and the names of its feature columns."""
    basic = X.basic_features(eligible(psms, options), options.match.masses, options.variable)
    met = joined(basic, scans, predictions, options.match.oxidation)
    own = spectra.spectral_features(met, options.match, options.minimal, delta_model)
    names = [*(spectra.MINIMAL if options.minimal else spectra.FULL), *(spectra.DELTA if delta_model else [])]
    # several predictions of one PSM: the best angle stays
    own = top_one(own, ["source", "scan", "peptide", "ptm_seq"], F.desc("spectralAngle"), F.desc("iRT"))
    own = X.imputed(own, "source", [*SENTINELS, *(spectra.DELTA if delta_model else [])])
    own = with_delta_rt(own)
    extra = ["deltaRT"]
    if binding is not None:
        best = best_binding(binding).select("peptide", "affinity")
        own = own.join(best, "peptide", "left").withColumn("logAffinity", log_affinity(F.col("affinity"))).drop("affinity")
        extra.append("logAffinity")
    numbered = X.unique_scan(own)
    columns = list(dict.fromkeys([*BASIC, *names, *extra]))
    return numbered, [c for c in columns if c not in options.excluded]


def with_delta_rt(df: DataFrame, q: float = 0.9, folds: int = 10) -> DataFrame:
    """Adds ``deltaRT`` from median-of-slopes lines through each file's best targets.

    The best are the targets at or above the exact quantile ``q`` of their file's
    angles. They are dealt to ``folds``, and each is held against the line of the
    other folds; all other rows against the mean of their file's lines. Where no
    row has a predicted time, one is made from residue counts.
    """
    if df.agg(F.count("iRT").alias("n")).first()["n"] == 0:
        df = fitted_times(df.drop("iRT"), train=F.col("Label") == 1, name="iRT")
    target = F.col("Label") == 1
    cut = df.where(target).groupBy("source").agg(F.percentile("spectralAngle", q).alias("__cut"))
    best = target & F.col("iRT").isNotNull() & F.col("retentionTime").isNotNull() & (F.col("spectralAngle") >= F.col("__cut"))
    marked = df.join(cut, "source", "left").withColumn("__fold", F.when(best, fold("source", "scan", "peptide", folds=folds))).drop("__cut")
    lines = fold_lines(marked.where(F.col("__fold").isNotNull()), ["source"], "iRT", "retentionTime", F.col("__fold"), folds)
    return X.delta_rt(marked, lines, fold="__fold").drop("__fold")


def assignments(features: DataFrame, columns: list[str], options: Options, proteins: DataFrame | None = None) -> DataFrame:
    """Scored PSMs; features with one value only are left out of the model."""
    stored_columns = X.informative(features, columns, options.excluded)
    scored = rescored(features, stored_columns, ["source", "scan"], options.folds, options.rounds, options.fdr)
    scored = scored.withColumn("modifiedSequence", P.mass_tagged(F.col("peptide"), F.col("ptm_seq"), options.match.masses))
    return with_proteins(scored, proteins) if proteins is not None else scored


def peptide_level(scored: DataFrame) -> DataFrame:
    """The best PSM of each peptide, with q-values among those."""
    best = top_one(scored, ["modifiedSequence", "Label"], F.desc("score"), F.asc("source"), F.asc("scan"))
    return q_values(best.drop("qValue"), "score", F.col("Label") == 1)


def report(scored: DataFrame, binder: Column | None = None) -> DataFrame:
    """Targets, and binders among them, below each q-value from 0.01 to 0.1."""
    also = {"nBinders": binder} if binder is not None else {}
    return fdr_curve(scored.where(F.col("Label") == 1), "qValue", [k / 100 for k in range(1, 11)], **also)


def compared_with_baseline(features: DataFrame, columns: list[str], options: Options) -> DataFrame:
    """The report with all features and with those that need no spectrum, side by side."""
    plain = [c for c in columns if c in BASIC]
    full = report(assignments(features, columns, options)).withColumnRenamed("n", "nAllFeatures")
    base = report(assignments(features, plain, options)).withColumnRenamed("n", "nWithoutSpectra")
    return full.join(base, "cut")


def spectral_angles(psms: DataFrame, scans: DataFrame, predictions: DataFrame, options: Options, binding: DataFrame | None = None) -> DataFrame:
    """Stand-alone query: angle, time deviation and binding of any PSM list."""
    met = joined(eligible(psms, options), scans, predictions, options.match.oxidation)
    own = spectra.spectral_features(met, options.match, minimal=True)
    own = with_delta_rt(own)
    if binding is not None:
        own = own.join(best_binding(binding), "peptide", "left")
    return own
