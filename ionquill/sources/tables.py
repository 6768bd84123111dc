"""Readers of proteomes, binding predictions, reports and other side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill.functions.peptides import fold_il


def read_fasta(spark: SparkSession, path: str | list[str], fold: bool = True) -> DataFrame:
    """``name``, ``description``, ``sequence`` of every entry; ``fold`` writes I as L."""
    entries = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("v")).where(F.trim("v") != "")
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    sequence = F.upper(F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"[\s*]", ""))
    return entries.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), head.alias("description"), (fold_il(sequence) if fold else sequence).alias("sequence"))


# Columns of the predictor's table, in order.
BINDING_COLUMNS = ["Pos", "MHC", "Peptide", "Core", "Of", "Gp", "Gl", "Ip", "Il", "Icore", "Identity", "Score_EL", "%Rank_EL", "Score_BA", "%Rank_BA", "Aff(nM)"]
_NUMBERS = {"Pos", "Of", "Gp", "Gl", "Ip", "Il", "Score_EL", "%Rank_EL", "Score_BA", "%Rank_BA", "Aff(nM)"}


def bind_level(rank: Column) -> Column:
    return F.when(rank < 0.5, "<=SB").when(rank < 2.0, "<=WB").otherwise("")


def read_binding(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """NetMHCpan's text tables: lines that begin with a position; the level is worked out again from the rank."""
    cells = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.get("c", F.lit(0)).rlike(r"^\d+$") & (F.size("c") >= len(BINDING_COLUMNS)))
    columns = [F.get("c", F.lit(k)).try_cast("double" if n in _NUMBERS else "string").alias(n) for k, n in enumerate(BINDING_COLUMNS)]
    return cells.select(*columns).withColumn("BindLevel", bind_level(F.col("`%Rank_BA`")))


def best_binding(binding: DataFrame) -> DataFrame:
    """Best allele of each peptide by rank; equal ranks go to the allele that comes first by name."""
    order = F.struct(F.col("`%Rank_BA`").alias("r"), F.col("MHC").alias("m"))
    best = binding.groupBy(F.col("Peptide").alias("peptide")).agg(F.min_by(F.struct(F.col("MHC").alias("allele"), F.col("`%Rank_BA`").alias("rank"), F.col("`Aff(nM)`").alias("affinity")), order).alias("b"))
    return best.select("peptide", "b.allele", "b.rank", "b.affinity", bind_level(F.col("b.rank")).alias("bindLevel"))


def binding_per_allele(binding: DataFrame, alleles: list[str]) -> DataFrame:
    """Affinities with a column for each allele."""
    return binding.groupBy(F.col("Peptide").alias("peptide")).pivot("MHC", alleles).agg(F.min("`Aff(nM)`"))


def read_ic50(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Least IC50 over one CSV for each allele, of peptides that every file has; ``peptide``, ``ic50``."""
    parts = [spark.read.csv(p, header=True).select("peptide", F.col("ic50").cast("double"), F.lit(a).alias("allele")) for a, p in paths.items()]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("peptide").agg(F.min("ic50").alias("ic50"), F.count_distinct("allele").alias("n")).where(F.col("n") == len(paths)).drop("n")


def log_affinity(affinity: Column) -> Column:
    """log10 of the affinity, 5 where there is none."""
    return F.coalesce(F.log10(affinity), F.lit(5.0))


def read_skyline(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, header=True).select("PeptideSequence", F.col("PrecursorCharge").try_cast("int").alias("PrecursorCharge"), "FileName", *[F.col(c).try_cast("double").alias(c) for c in ("IsotopeDotProduct", "TotalAreaMs1", "TotalBackgroundMs1")])


# Output columns of the rescorers: id, score, q-value, error probability, peptide, proteins.
RESCORER_COLUMNS = {
    "percolator": ("PSMId", "score", "q-value", "posterior_error_prob", "peptide", "proteinIds"),
    "mokapot": ("specID", "mokapot score", "mokapot q-value", "mokapot PEP", "peptide", "proteins"),
}


def read_rescored(spark: SparkSession, path: str | list[str], method: str = "percolator") -> DataFrame:
    """A rescorer's table; flanks like ``-.PEP.-`` are taken off the peptide."""
    names = RESCORER_COLUMNS[method]
    t = spark.read.csv(path, sep="\t", header=True)
    bare = F.regexp_replace(f"`{names[4]}`", r"^-\.|\.-$", "")
    number = lambda n: F.col(f"`{n}`").cast("double")
    return t.select(F.col(f"`{names[0]}`").alias("psmId"), number(names[1]).alias("score"), number(names[2]).alias("qValue"), number(names[3]).alias("postErrProb"), bare.alias("peptide"), F.col(f"`{names[5]}`").alias("proteins"))


def read_distiller_log(spark: SparkSession, path: str) -> list[str]:
    """Names of the raw files that a log lists, in its order; a log is one small file."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract_all(F.col("value"), F.lit(r"([^\\/\s\"]+)\.raw"), F.lit(1)).alias("n")).first()
    return list(dict.fromkeys(text["n"])) if text else []


def read_weights(spark: SparkSession, path: str, folds: int = 3) -> DataFrame:
    """Weights of a rescorer's models as ``fold``, ``feature``, ``weight``: its file repeats a header, normalised and raw weights for each fold."""
    text = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("# "))).alias("l"))
    rows = text.select(F.posexplode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold", "k"), "l")
    named = rows.select("fold", F.split(F.regexp_replace(F.get("l", F.col("k") * 3), "^#", ""), "\t").alias("n"), F.split(F.get("l", F.col("k") * 3 + 1), "\t").alias("w")).where(F.col("n").isNotNull() & F.col("w").isNotNull())
    return named.select("fold", F.explode(F.arrays_zip("n", "w")).alias("x")).select("fold", F.col("x.n").alias("feature"), F.col("x.w").try_cast("double").alias("weight"))


def extreme_weights(weights: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` features of largest and of least mean weight; ``feature``, ``weight``, ``side``."""
    means = weights.groupBy("feature").agg(F.avg("weight").alias("weight"))
    side = lambda order, name: means.orderBy(order, "feature").limit(n).withColumn("side", F.lit(name))
    return side(F.desc("weight"), "top").unionByName(side(F.asc("weight"), "bottom"))
