"""Plans that follow identification: quantities, epitope candidates, validation of spliced peptides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.constants import RESIDUE_MASS
from ionquill.functions import peptides as P
from ionquill.functions.arrays import lookup, total
from ionquill.operators import quantification as Q
from ionquill.operators.proteome import origin
from ionquill.operators.relational import isobaric_join, outer_with_indicator, sub_sequences, top_one, without_controls


def quantified(report: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
    """Long quantities, sample means and the comparison of infected and control samples."""
    long = Q.normalised(Q.formatted(report))
    means = Q.sample_means(long, samples)
    return {"quantities": long, "sampleMeans": means, "comparison": Q.compared(means)}


def confidence(error: Column) -> Column:
    """Percent confidence to two decimals, rounded down."""
    return F.floor((1 - error) * 10_000) / 100


def is_control(source: Column, flags: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.contains(source, F.lit(f))
    return out


def candidates(
    scored: DataFrame, host: DataFrame, pathogen: DataFrame, controls: tuple[str, ...] = (), q: float = 0.01, pep: float = 0.1, longest: int = 15,
    comparison: DataFrame | None = None, binding: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Epitope candidates: confident peptides of the pathogen alone that no control sample has.

    ``candidates`` has a row for each peptide with its files, ``excluded`` the
    peptides that both proteomes hold or a control has, ``host`` those of the
    host.
    """
    sure = scored.where((F.col("Label") == 1) & (F.col("qValue") < q) & (F.col("postErrProb") < pep) & (F.length("peptide") <= longest))
    placed = origin(sure, host, pathogen)
    own = placed.where(F.col("origin") == "pathogen")
    kept = without_controls(own, ["peptide"], is_control(F.col("source"), controls))
    per = kept.groupBy("peptide", "modifiedSequence").agg(
        F.count_distinct("source").alias("nFiles"), F.sort_array(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("nPsms"),
        F.max("score").alias("score"), F.min("postErrProb").alias("postErrProb"), F.max("spectralAngle").alias("spectralAngle") if "spectralAngle" in scored.columns else F.lit(None).cast("double").alias("spectralAngle"),
    ).withColumn("confidence", confidence(F.col("postErrProb")))
    if comparison is not None:
        per = per.join(comparison.select("peptide", "foldChange", "pValue", "pAdjusted", "regulation"), "peptide", "left")
    if binding is not None:
        per = per.join(binding, "peptide", "left")
    excluded = placed.where(F.col("origin") == "both").unionByName(own.join(kept.select("peptide").distinct(), "peptide", "left_anti"))
    return {"candidates": per, "excluded": excluded, "host": placed.where(F.col("origin") == "host")}


def engines_compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """Peptides of two engines with which of them found each: both, left_only or right_only."""
    return outer_with_indicator(first.select("peptide").distinct(), second.select("peptide").distinct(), ["peptide"])


def without_contaminants(scored: DataFrame, contaminants: DataFrame) -> DataFrame:
    """PSMs that no better contaminant explains: none for the scan, the same peptide (I as L), or a smaller angle."""
    rival = top_one(contaminants, ["source", "scan"], F.desc("spectralAngle"), F.asc("peptide")).select("source", "scan", F.col("peptide").alias("__p"), F.col("spectralAngle").alias("__a"))
    met = scored.join(rival, ["source", "scan"], "left")
    fine = F.col("__p").isNull() | (P.fold_il(F.col("peptide")) == P.fold_il(F.col("__p"))) | (F.col("spectralAngle") > F.col("__a"))
    return met.where(fine).drop("__p", "__a")


def residue_mass(sequence: Column) -> Column:
    return total(F.transform(P.residues(sequence), lambda r: lookup(RESIDUE_MASS, r)))


def oxidation_placements(sequence: Column, n: Column) -> Column:
    """Codes of all ways to oxidise ``n`` methionines of a sequence.

    Ways grow one methionine at a time, so a peptide with m of them has at most
    2 ^ m at work; peptides have at most 30 residues.
    """
    empty = F.array(F.struct(F.lit("").alias("code"), F.lit(0).alias("used")))

    def add(ways: Column, r: Column) -> Column:
        plain = F.transform(ways, lambda w: F.struct(F.concat(w["code"], F.lit("0")).alias("code"), w["used"].alias("used")))
        more = F.transform(F.filter(ways, lambda w: w["used"] < n), lambda w: F.struct(F.concat(w["code"], F.lit("2")).alias("code"), (w["used"] + 1).alias("used")))
        return F.when(r == "M", F.concat(plain, more)).otherwise(plain)

    ways = F.aggregate(P.residues(sequence), empty, add)
    return F.transform(F.filter(ways, lambda w: w["used"] == n), lambda w: F.concat(F.lit("0."), w["code"], F.lit(".0")))


def isobaric_competitors(spliced: DataFrame, proteins: DataFrame, low: int = 7, high: int = 30) -> DataFrame:
    """Parts of proteins as heavy (to two decimals) as each spliced peptide, with all placements of its oxidations."""
    parts = sub_sequences(proteins.select("sequence"), "sequence", low, high, "part").select("part").distinct()
    parts = parts.where(P.predictable(F.col("part"), F.lit(2))).select("part", residue_mass(F.col("part")).alias("mw"))
    own = spliced.select("source", "scan", "charge", "peptide", "ptm_seq", residue_mass(F.col("peptide")).alias("mw"))
    met = isobaric_join(own, parts, "mw")
    n = F.regexp_count(F.coalesce("ptm_seq", F.lit("")), F.lit("2"))
    placed = met.withColumn("__codes", F.when(n > 0, oxidation_placements(F.col("other_part"), n)).otherwise(F.array(F.lit(None).cast("string"))))
    return placed.select("source", "scan", "charge", F.col("other_part").alias("peptide"), F.explode("__codes").alias("ptm_seq"))


def validated(spliced: DataFrame, competitors: DataFrame, score: str = "reScore", rival: str = "compScore") -> DataFrame:
    """Spliced PSMs that score above the best competitor of their scan; without one they stay."""
    best = competitors.groupBy("source", "scan").agg(F.max(rival).alias("__best"))
    return spliced.join(best, ["source", "scan"], "left").where(F.col(score) > F.coalesce("__best", F.lit(-100_000.0))).drop("__best")
