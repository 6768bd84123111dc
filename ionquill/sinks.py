"""Writers of predictor inputs, feature tables, assignments and proteomes.

Every writer takes a DataFrame and a folder; Spark writes the part files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.functions.peptides import mass_tagged, named_modifications, predictor_sequence, psm_id
from ionquill.operators.proteome import with_decoys
from ionquill.operators.relational import batched


def predictor_input(psms: DataFrame, energies: list[float] | dict[str, float] | float, oxidation: str = "2") -> DataFrame:
    """Distinct ``modified_sequence``, ``precursor_charge``, ``collision_energy``.

    One energy, a list of them, or one for each source; sources that the table
    doesn't name are left out.
    """
    rows = psms.withColumn("modified_sequence", predictor_sequence(F.col("peptide"), F.col("ptm_seq"), oxidation))
    if isinstance(energies, dict):
        table = F.create_map(*[F.lit(x) for pair in energies.items() for x in pair])
        rows = rows.withColumn("collision_energy", F.try_element_at(table, F.col("source"))).where(F.col("collision_energy").isNotNull())
    else:
        values = energies if isinstance(energies, list) else [energies]
        rows = rows.withColumn("collision_energy", F.explode(F.array(*map(F.lit, values))))
    return rows.select("modified_sequence", F.col("charge").alias("precursor_charge"), "collision_energy").distinct()


def write_predictor_input(psms: DataFrame, path: str, energies: list[float] | dict[str, float] | float, append: bool = False, oxidation: str = "2") -> None:
    predictor_input(psms, energies, oxidation).write.mode("append" if append else "overwrite").csv(path, header=True)


def preprec(psms: DataFrame, names: dict[int, str]) -> DataFrame:
    """Distinct peptide, modification string and charge with an id, for the second predictor."""
    rows = psms.select("peptide", named_modifications(F.col("ptm_seq"), names).alias("modifications"), "charge").distinct()
    ident = F.concat(F.lit("peptide_"), F.lower(F.hex(F.xxhash64("peptide", "modifications", "charge"))))
    return rows.select(ident.alias("spec_id"), "modifications", "peptide", "charge")


def write_preprec(psms: DataFrame, path: str, names: dict[int, str]) -> None:
    preprec(psms, names).write.mode("overwrite").csv(path, sep=" ", header=True, quote="")


def binding_batches(psms: DataFrame, size: int = 500) -> DataFrame:
    """Distinct peptides with their length and batch number, ``size`` to a batch."""
    distinct = psms.select("peptide", F.length("peptide").alias("length")).distinct()
    return batched(distinct, ["length"], size, F.asc("peptide"))


def write_binding_batches(psms: DataFrame, path: str, size: int = 500) -> None:
    binding_batches(psms, size).select("length", "batch", "peptide").write.mode("overwrite").partitionBy("length", "batch").text(path)


def msp_record(peptide: Column, charge: Column, energy: Column, irt: Column, ions: Column, intensities: Column) -> Column:
    """One library entry as text."""
    peaks = F.zip_with(ions, intensities, lambda i, x: F.concat(F.lit("0.0\t"), x.cast("string"), F.lit('\t"'), i, F.lit('/0.0ppm"')))
    bare = F.regexp_replace(peptide, r"\(ox\)", "")
    before = F.slice(F.split(peptide, r"\(ox\)"), F.lit(1), F.size(F.split(peptide, r"\(ox\)")) - 1)
    places = F.transform(before, lambda x, i: F.length(F.array_join(F.slice(before, F.lit(1), i + 1), "")))
    mods = F.array_join(F.transform(places, lambda p: F.concat(F.lit("Oxidation@M"), (p + 1).cast("string"))), "; ")
    number = F.size(places).cast("string")
    return F.concat(
        F.lit("Name: "), bare, F.lit("/"), charge.cast("string"), F.lit("\nMW: 0.0\nComment: Parent=0.0 Collision_energy="), energy.cast("string"), F.lit(" Mods="), number,
        F.lit(" ModString="), bare, F.lit("//"), mods, F.lit("/"), charge.cast("string"), F.lit(" iRT="), irt.cast("string"), F.lit("\nNum peaks: "), F.size(ions).cast("string"),
        F.lit("\n"), F.array_join(peaks, "\n"),
    )


def write_msp(predictions: DataFrame, path: str) -> None:
    """Predictions as ``read_msp`` gives them, written as a library."""
    record = msp_record(F.col("modified_sequence"), F.col("charge"), F.col("collisionEnergy"), F.col("iRT"), F.col("ions"), F.col("intensities"))
    predictions.select(record.alias("value")).write.mode("overwrite").text(path)


def rescorer_input(features: DataFrame, columns: list[str], masses: dict[int, float]) -> DataFrame:
    """PSM id, label, scan number, features, flanked peptide and proteins, in the order that rescorers read."""
    modified = mass_tagged(F.col("peptide"), F.col("ptm_seq"), masses)
    return features.select(
        psm_id(F.col("source"), F.col("scan"), modified).alias("specID"), "Label", "scannr", *columns,
        F.concat(F.lit("-."), modified, F.lit(".-")).alias("peptide"), "proteins",
    )


def write_rescorer_input(features: DataFrame, path: str, columns: list[str], masses: dict[int, float]) -> None:
    rescorer_input(features, columns, masses).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_features(features: DataFrame, path: str, append: bool = False) -> None:
    """The feature table, one folder for each source."""
    features.write.mode("append" if append else "overwrite").partitionBy("source").parquet(path)


def write_fasta(proteins: DataFrame, path: str, decoys: bool = True, contaminants: DataFrame | None = None) -> None:
    """Proteins, contaminants and the reversed decoys of both."""
    every = proteins.select("name", "sequence")
    if contaminants is not None:
        every = every.unionByName(contaminants.select(F.concat(F.lit("contaminant_"), "name").alias("name"), "sequence"))
    every = with_decoys(every) if decoys else every
    every.select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(path)


def ssl_table(assignments: DataFrame, q: float = 0.01) -> DataFrame:
    """Identifications below a q-value as Skyline reads them."""
    return assignments.where(F.col("qValue") < q).select(
        F.col("source").alias("file"), "scan", "charge", F.col("modifiedSequence").alias("sequence"), F.lit("PERCOLATOR QVALUE").alias("score-type"), F.col("qValue").alias("score"), F.col("retentionTime").alias("retention-time")
    )


def write_ssl(assignments: DataFrame, path: str, q: float = 0.01) -> None:
    ssl_table(assignments, q).write.mode("overwrite").csv(path, sep="\t", header=True)


def excluded_table(excluded: DataFrame, sources: list[str]) -> DataFrame:
    """Peptides with a 0/1 column for each source and the number of PSMs."""
    found = [F.max((F.col("source") == s).cast("int")).alias(s) for s in sources]
    return excluded.groupBy("peptide").agg(F.count(F.lit(1)).alias("nPsms"), *found)


def write_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    """Result tables by name, as Parquet."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
