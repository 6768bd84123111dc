"""Choice of a predictor setting, such as the collision energy, by mean agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.operators.relational import top_one
from ionquill.operators.running import exact_quantile_nearest


def best_setting(scored: DataFrame, keys: list[str], setting: str, score: str) -> DataFrame:
    """The setting with the largest mean score for each key; equal means (to 9 places) go to the lower setting."""
    means = scored.groupBy(*keys, setting).agg(F.round(F.avg(score), 9).alias("meanScore"))
    return top_one(means, keys, F.desc("meanScore"), F.asc(setting)) if keys else means.orderBy(F.desc("meanScore"), setting).limit(1)


def calibration_rows(psms: DataFrame, known: Column, score: str = "engineScore", q: float = 0.9, most: int = 600, per: str | None = "source") -> DataFrame:
    """Targets with known modifications in the first stratum whose score is above its nearest-rank quantile; the best ``most`` of each file."""
    fit = psms.where((F.col("Label") == 1) & known)
    if "accessionGroup" in psms.columns:
        fit = fit.where(F.col("accessionGroup") == 0)
    cut = exact_quantile_nearest(fit, score, q)
    if cut is None:
        return fit
    above = fit.where(F.col(score) > cut)
    order = [F.desc(score), F.asc("source"), F.asc("scan"), F.asc("peptide")]
    if per is None:
        return above.orderBy(*order).limit(most)
    from ionquill.operators.relational import top_k

    return top_k(above, [per], most, *order)


def with_settings(psms: DataFrame, low: int = 20, high: int = 40, name: str = "collisionEnergy") -> DataFrame:
    """Each row once for every setting."""
    return psms.withColumn(name, F.explode(F.sequence(F.lit(low), F.lit(high))))


def calibrated(scored: DataFrame, per_file: bool = True, setting: str = "collisionEnergy", score: str = "spectralAngle") -> DataFrame:
    """Collision energy of each file, or one for all, by mean spectral angle."""
    return best_setting(scored, ["source"] if per_file else [], setting, score)
