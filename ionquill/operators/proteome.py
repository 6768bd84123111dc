"""Peptides and proteomes: decoys, accession groups and mapping by k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.functions.peptides import fold_il
from ionquill.operators.relational import substring_join

SEED = 5


def with_decoys(proteins: DataFrame, mark: str = "rev_") -> DataFrame:
    """All proteins and their reversed sequences, whose names begin with ``mark``."""
    return proteins.unionByName(proteins.withColumns({"name": F.concat(F.lit(mark), F.col("name")), "sequence": F.reverse("sequence")}))


def decoy_label(proteins: Column, mark: str = "rev_", separator: str = ";") -> Column:
    """-1 where every protein of the list is a decoy, 1 otherwise."""
    names = F.split(proteins, separator)
    return F.when(F.forall(names, lambda p: F.startswith(p, F.lit(mark))), -1).otherwise(1)


def accession_group(proteins: Column, hierarchy: list[str], separator: str, unmatched: int = 0, unknown: tuple[str, ...] = ("deNovo", "unknown")) -> Column:
    """Lowest place in ``hierarchy`` of a name that any protein of the list holds.

    Parts that hold none count ``unmatched``; the words in ``unknown`` count as
    the place after the last.
    """

    def place(part: Column) -> Column:
        found = F.when(part.isin(*unknown), len(hierarchy))
        for k, name in enumerate(hierarchy):
            found = found.when(F.contains(part, F.lit(name)), k)
        return found.otherwise(unmatched)

    return F.array_min(F.transform(F.split(proteins, separator), place))


def one_hot(stratum: Column, names: list[str]) -> list[Column]:
    """A 0/1 column ``accession_<name>`` for each stratum."""
    return [F.when(stratum == k, 1).otherwise(0).alias(f"accession_{n}") for k, n in enumerate(names)]


def from_one_hot(names: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col(f"accession_{n}") == 1, k) for k, n in enumerate(names)])


def stratum_weighted(score: Column, stratum: Column, factor: float = 0.7) -> Column:
    return F.when(stratum == 0, score).otherwise(score * factor)


def mapped(peptides: DataFrame, proteins: DataFrame, peptide: str = "peptide", reverse: bool = False) -> DataFrame:
    """Every protein that holds each distinct peptide, I and L taken as one; ``peptide``, ``protein``, ``position`` from 1.

    ``reverse`` looks in the reversed proteins instead.
    """
    distinct = peptides.select(F.col(peptide).alias("peptide")).where(F.col("peptide").isNotNull()).distinct().withColumn("__pep", fold_il(F.col("peptide")))
    body = F.reverse("sequence") if reverse else F.col("sequence")
    hays = proteins.select(F.col("name").alias("protein"), fold_il(body).alias("__body"))
    return substring_join(distinct, hays, "__pep", "__body", SEED, "peptide", "protein")


def with_proteins(psms: DataFrame, proteins: DataFrame, name: str = "proteins", missing: str = "unknown") -> DataFrame:
    """Adds the sorted names of all proteins that hold a row's peptide, joined by ``;``."""
    names = mapped(psms, proteins).groupBy("peptide").agg(F.array_join(F.sort_array(F.collect_set("protein")), ";").alias(name))
    return psms.drop(name).join(names, "peptide", "left").withColumn(name, F.coalesce(name, F.lit(missing)))


def origin(psms: DataFrame, host: DataFrame, other: DataFrame) -> DataFrame:
    """Adds ``origin``: host, pathogen, both or unknown, by which proteome holds the peptide."""
    hit = lambda p, flag: mapped(psms, p).select("peptide").distinct().withColumn(flag, F.lit(True))
    joined = psms.join(hit(host, "__h"), "peptide", "left").join(hit(other, "__o"), "peptide", "left")
    h, o = F.coalesce("__h", F.lit(False)), F.coalesce("__o", F.lit(False))
    kind = F.when(h & o, "both").when(h, "host").when(o, "pathogen").otherwise("unknown")
    return joined.withColumn("origin", kind).drop("__h", "__o")
