"""Queries of readers and writers: each writes a format made from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill import sinks
from ionquill.constants import PROTON
from ionquill.operators import spectra as spectra_ops
from ionquill.operators.proteome import mapped, with_decoys
from ionquill.plans.registry import query, table
from ionquill.plans.vector_queries import PEPTIDES, _mass_case, part_peptides
from ionquill.sources import searches, spectra, tables
from ionquill.storage import new_path


def written(df: DataFrame, value: Column, label: str) -> str:
    """Path of a text file with one entry of ``df`` after another."""
    path = new_path(df.sparkSession, label)
    df.select(value.alias("value")).write.text(path)
    return path


def headed(df: DataFrame, label: str, sep: str) -> str:
    path = new_path(df.sparkSession, label)
    df.write.csv(path, header=True, sep=sep, quote='"', escape='"')
    return path


def text(c: Column) -> Column:
    return c.cast("string")


FITTING = PEPTIDES + ", f AS (SELECT p_partkey, s FROM p WHERE length(s) BETWEEN 5 AND 30)"


def fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_peptides(spark, sf_dir).where(F.length("s").between(5, 30))


@query(
    "SELECT vec_id AS scan, 2::INTEGER AS charge, round(vec_id / 10.0, 3) AS rt, 64::INTEGER AS n_peaks, round(list_sum(list_transform(embedding, lambda x: round(abs(x::DOUBLE), 5))), 5) AS total FROM embeddings"
)
def q_source_mgf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 5)).alias("v"))
    peaks = F.array_join(F.transform("v", lambda x, i: F.concat(text(F.lit(100.25) + i), F.lit(" "), text(x))), "\n")
    block = F.concat(F.lit("BEGIN IONS\nTITLE=made scan="), text(F.col("vec_id")), F.lit("\nPEPMASS=500.5 1000\nCHARGE=2+\nRTINSECONDS="), text(F.round(F.col("vec_id") / 10.0, 3)), F.lit("\n"), peaks, F.lit("\nEND IONS"))
    got = spectra.read_mgf(spark, written(e, block, "mgf"))
    return got.select("scan", "charge", F.round("retentionTime", 3).alias("rt"), F.size("mzs").alias("n_peaks"), F.round(F.aggregate("intensities", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT vec_id AS scan, 3::INTEGER AS charge, 64::INTEGER AS n_peaks, round(list_max(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS top, round(vec_id * 60.0::DOUBLE, 1) AS rt FROM embeddings")
def q_source_mzml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as 64-bit floats in base64, packed here by the JVM from the bits of each number."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    packed = spark_packed(e, "v")
    param = lambda acc, value="", more="": F.lit(f'<cvParam accession="{acc}" value="{value}"{more}/>')
    array = lambda kind: F.concat(F.lit("<binaryDataArray>"), param("MS:1000523"), param("MS:1000576"), param(kind), F.lit("<binary>"), F.col("b64"), F.lit("</binary></binaryDataArray>"))
    body = F.concat(
        F.lit('<spectrum index="0" id="scan='), text(F.col("vec_id")), F.lit('">'), param("MS:1000511", "2"), F.lit('<scan><cvParam accession="MS:1000016" value="'), text(F.col("vec_id")), F.lit('" unitName="minute"/></scan>'),
        F.lit("<precursor><selectedIon>"), param("MS:1000744", "500.5"), param("MS:1000041", "3"), F.lit("</selectedIon></precursor>"), array("MS:1000514"), array("MS:1000515"), F.lit("</spectrum>"),
    )
    got = spectra.read_mzml(spark, written(packed, body, "mzml"))
    return got.select("scan", "charge", F.size("mzs").alias("n_peaks"), F.round(F.array_max("intensities"), 6).alias("top"), F.round("retentionTime", 1).alias("rt"))


def spark_packed(df: DataFrame, column: str) -> DataFrame:
    """Adds ``b64``: an array column as little-endian doubles in base64."""
    import base64

    import numpy as np
    import pyarrow as pa

    names = df.columns

    def run(batches):
        for batch in batches:
            at = batch.column(column).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base64.b64encode(np.array(x, "<f8").tobytes()).decode() for x in at])], names=[*names, "b64"])

    return df.mapInArrow(run, df.withColumn("b64", F.lit("")).schema)


@query(
    FITTING + " SELECT s AS peptide, p_partkey AS irt, replace(s, 'M', 'M(ox)') AS modified, (length(s) - 1)::INTEGER AS n_ions, 1.0::DOUBLE AS norm FROM f"
)
def q_source_msp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library written by ``write_msp`` and read again."""
    f = fitting(spark, sf_dir)
    ions = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.concat(F.lit("b"), text(i)))
    lib = f.select(
        F.regexp_replace("s", "M", "M(ox)").alias("modified_sequence"), F.lit(2).alias("charge"), F.lit(30.0).alias("collisionEnergy"), F.col("p_partkey").alias("iRT"),
        ions.alias("ions"), F.transform(ions, lambda x, i: (i + 1) / 10.0).alias("intensities"),
    )
    path = new_path(spark, "msp")
    sinks.write_msp(lib, path)
    got = spectra.read_msp(spark, path)
    norm = F.round(F.sqrt(F.aggregate("intensities", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return got.select("peptide", F.col("iRT").cast("long").alias("irt"), F.col("modified_sequence").alias("modified"), F.size("ions").alias("n_ions"), norm.alias("norm"))


@query(PEPTIDES + " SELECT name, sequence FROM (SELECT 'P' || p_partkey AS name, replace(s, 'I', 'L') AS sequence FROM p UNION ALL SELECT 'rev_P' || p_partkey, replace(reverse(s), 'I', 'L') FROM p)")
def q_source_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target-decoy proteome written as FASTA and read again, I as L."""
    proteins = part_peptides(spark, sf_dir).select(F.concat(F.lit("P"), text(F.col("p_partkey"))).alias("name"), F.col("s").alias("sequence"))
    path = new_path(spark, "fasta")
    sinks.write_fasta(proteins, path)
    return tables.read_fasta(spark, path).select("name", "sequence")


ORDERS = FITTING + ", o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, s FROM orders JOIN f ON o_orderkey % (SELECT count(*) FROM part) = p_partkey)"


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as PSMs: the key is the scan, the price the score, a part's name the peptide."""
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % n).alias("k"))
    return o.join(fitting(spark, sf_dir), F.col("k") == F.col("p_partkey")).drop("k")


@query(
    ORDERS + " SELECT o_orderkey AS scan, s AS peptide, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS label, CASE WHEN contains(s, 'M') THEN '0.' || replace(regexp_replace(s, '[^M]', '0', 'g'), 'M', '2') || '.0' END AS code,"
    " CASE WHEN o_orderstatus = 'F' THEN 'reverseSeq' ELSE 'C' || o_custkey END AS proteins, round(o_totalprice, 2) AS score FROM o"
)
def q_source_maxquant(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("s")
    rows = searched(spark, sf_dir).select(
        F.lit("run").alias("Raw file"), F.col("o_orderkey").alias("Scan number"), F.col("s").alias("Sequence"), F.concat(F.lit("_"), F.regexp_replace("s", "M", "M(ox)"), F.lit("_")).alias("Modified sequence"),
        F.concat(F.lit("C"), text(F.col("o_custkey"))).alias("Proteins"), F.lit(2).alias("Charge"), F.when(F.col("o_orderstatus") == "F", "+").alias("Reverse"), F.lit(1.5).alias("Delta score"), n.alias("Length"),
        (n * 110).alias("Mass"), F.lit(0).alias("Missed cleavages"), F.lit(0.5).alias("Simple mass error [ppm]"), F.col("o_totalprice").alias("Score"), F.lit(1.0).alias("Retention time"),
    )
    got = searches.read_maxquant(spark, headed(rows, "maxquant", "\t"))
    return got.select("scan", "peptide", F.col("Label").alias("label"), F.col("ptm_seq").alias("code"), "proteins", F.round("engineScore", 2).alias("score"))


@query(
    ORDERS + " SELECT o_orderkey AS scan, s AS peptide, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS label, CASE WHEN contains(s, 'M') THEN '0.' || replace(regexp_replace(s, '[^M]', '0', 'g'), 'M', '2') || '.0' END AS code, round(o_totalprice, 2) AS score FROM o"
)
def q_source_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = searched(spark, sf_dir).select(
        F.concat(F.when(F.col("o_orderstatus") == "F", "#DECOY#").otherwise(""), F.lit("C"), text(F.col("o_custkey"))).alias("Accession"), F.lit("").alias("AScore"), F.lit(2).alias("Z"), F.lit("No").alias("from Chimera"),
        F.length("s").alias("Length"), F.lit(900.5).alias("Mass"), F.lit(450.5).alias("m/z"), F.regexp_replace("s", "M", "M(+15.99)").alias("Peptide"), F.lit(0.1).alias("ppm"), F.lit("").alias("PTM"), F.lit(5.5).alias("RT"),
        F.concat(F.lit("F1:"), text(F.col("o_orderkey"))).alias("Scan"), F.col("o_totalprice").alias("-10lgP"), F.lit("a.raw").alias("Source File"),
    )
    got = searches.read_peaks(spark, headed(rows, "peaks", ","))
    return got.select("scan", "peptide", F.col("Label").alias("label"), F.col("ptm_seq").alias("code"), F.round("engineScore", 2).alias("score"))


@query(
    ORDERS + " SELECT o_orderkey AS scan, s AS peptide, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS label, CASE WHEN contains(s, 'M') THEN '0.' || replace(regexp_replace(s, '[^M]', '0', 'g'), 'M', '2') || '.0' END AS code, round(o_totalprice, 2) AS score, round(o_totalprice, 2) AS delta FROM o"
)
def q_source_pepxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    protein = F.concat(F.when(F.col("o_orderstatus") == "F", "rev_").otherwise(""), F.lit("C"), text(F.col("o_custkey")))
    body = F.concat(
        F.lit('<spectrum_query spectrum="run.1.'), text(F.col("o_orderkey")), F.lit("."), text(F.col("o_orderkey")), F.lit('.2" assumed_charge="2" retention_time_sec="5.5"><search_result><search_hit peptide="'), F.col("s"),
        F.lit('" massdiff="0.1" calc_neutral_pep_mass="900" num_missed_cleavages="0" protein="'), protein, F.lit('"><modification_info modified_peptide="'), F.regexp_replace("s", "M", "M[147]"),
        F.lit('"/><search_score name="hyperscore" value="'), text(F.col("o_totalprice")), F.lit('"/></search_hit></search_result></spectrum_query>'),
    )
    got = searches.read_pepxml(spark, written(searched(spark, sf_dir), body, "pepxml"))
    return got.select("scan", "peptide", F.col("Label").alias("label"), F.col("ptm_seq").alias("code"), F.round("engineScore", 2).alias("score"), F.round("deltaScore", 2).alias("delta"))


@query(ORDERS + " SELECT o_orderkey AS scan, s AS peptide, round(o_totalprice, 2) AS score, 'C' || o_custkey AS proteins, CASE WHEN contains(s, 'M') THEN '0.' || replace(regexp_replace(s, '[^M]', '0', 'g'), 'M', '2') || '.0' END AS code FROM o")
def q_source_psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = searched(spark, sf_dir).select(
        F.lit("run").alias("source"), F.col("o_orderkey").alias("scan"), F.col("s").alias("peptide"), F.regexp_replace("s", "M", "M[+16.0]").alias("modifiedSequence"), F.lit(2).alias("charge"),
        F.col("o_totalprice").alias("Score"), F.concat(F.lit("C"), text(F.col("o_custkey"))).alias("proteins"),
    )
    got = searches.read_psms(spark, headed(rows, "psms", ","))
    return got.select("scan", "peptide", F.round("engineScore", 2).alias("score"), "proteins", F.col("ptm_seq").alias("code"))


@query("SELECT p_partkey || '' AS peptide, min(round(p_retailprice + l_suppkey, 2)) AS affinity, CASE WHEN min(round(p_retailprice + l_suppkey, 2)) / 1000 < 0.5 THEN '<=SB' WHEN min(round(p_retailprice + l_suppkey, 2)) / 1000 < 2 THEN '<=WB' ELSE '' END AS level FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1")
def q_source_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binding predictor's text table, its best row for each peptide and the level."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    j = l.join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    x = F.round(F.col("p_retailprice") + F.col("l_suppkey"), 2)
    peptide = text(F.col("p_partkey"))
    line = F.concat_ws(" ", F.lit("   1 "), F.concat(F.lit("A"), text(F.col("l_suppkey"))), peptide, peptide, F.lit("0 0 0 0 0"), peptide, F.lit("PEPLIST 0.5 1.0 0.4"), text(x / 1000), text(x), F.lit("<= WB"))
    got = tables.best_binding(tables.read_binding(spark, written(j, line, "binding")))
    return got.select("peptide", "affinity", F.col("bindLevel").alias("level"))


@query("SELECT l_partkey::VARCHAR AS peptide, 'f' || (l_suppkey % 4) AS source, max(greatest(round(l_extendedprice - l_quantity, 2), 0)) AS raw FROM lineitem GROUP BY 1, 2")
def q_source_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantification report: background taken off, largest area of each peptide and file."""
    from ionquill.operators.quantification import formatted

    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("PeptideSequence"), F.lit(2).alias("PrecursorCharge"), F.concat(F.lit("f"), text(F.col("l_suppkey") % 4), F.lit(".raw")).alias("FileName"), F.lit(0.9).alias("IsotopeDotProduct"),
        F.col("l_extendedprice").alias("TotalAreaMs1"), F.col("l_quantity").alias("TotalBackgroundMs1"),
    )
    got = formatted(tables.read_skyline(spark, headed(rows, "skyline", ",")))
    return got.select("peptide", "source", F.round("raw", 2).alias("raw"))


@query(FITTING + " SELECT DISTINCT replace(s, 'M', 'M(ox)') AS modified_sequence, 2::INTEGER AS precursor_charge, ce::INTEGER AS collision_energy FROM f, (VALUES (25), (30)) t(ce)")
def q_sink_predictor_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("0."), F.regexp_replace(F.regexp_replace("s", "[^M]", "0"), "M", "2"), F.lit(".0"))
    psms = fitting(spark, sf_dir).select(F.lit("run").alias("source"), F.col("s").alias("peptide"), code.alias("ptm_seq"), F.lit(2).alias("charge"))
    path = new_path(spark, "predictor")
    sinks.write_predictor_input(psms, path, [25, 30])
    return spark.read.csv(path, header=True, schema="modified_sequence string, precursor_charge int, collision_energy int")


@query(PEPTIDES + ", d AS (SELECT DISTINCT s AS peptide FROM p WHERE length(s) > 0), h AS (SELECT 'P' || p_partkey AS protein, replace(s, 'I', 'L') AS body FROM p) SELECT peptide, protein, instr(body, replace(peptide, 'I', 'L'))::INTEGER AS position FROM d JOIN h ON contains(body, replace(peptide, 'I', 'L'))")
def q_proteome_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_peptides(spark, sf_dir)
    proteins = p.select(F.concat(F.lit("P"), text(F.col("p_partkey"))).alias("name"), F.col("s").alias("sequence"))
    return mapped(p.where(F.length("s") > 0).select(F.col("s").alias("peptide")), proteins)


@query(PEPTIDES + " SELECT name, length(sequence)::INTEGER AS n, starts_with(name, 'rev_') AS decoy FROM (SELECT 'P' || p_partkey AS name, s AS sequence FROM p UNION ALL SELECT 'rev_P' || p_partkey, reverse(s) FROM p)")
def q_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_peptides(spark, sf_dir).select(F.concat(F.lit("P"), text(F.col("p_partkey"))).alias("name"), F.col("s").alias("sequence"))
    return with_decoys(p).select("name", F.length("sequence").alias("n"), F.startswith("name", F.lit("rev_")).alias("decoy"))


@query(
    PEPTIDES + ", r AS (SELECT p_partkey, length(s) AS n, i, 1.0::DOUBLE / (1 + i % 5) AS pred, 0.1::DOUBLE + ((p_partkey * 7 + i * 13) % 10) AS obs FROM p, range(1, 40) t(i) WHERE i < length(s) AND length(s) BETWEEN 5 AND 30),"
    " a AS (SELECT p_partkey, n, sum(pred * obs) AS d, sqrt(sum(pred * pred)) AS np, sqrt(sum(obs * obs)) AS no, corr(pred, obs) AS r FROM r GROUP BY 1, 2)"
    " SELECT p_partkey, round(1 - 2 * acos(least(1, d / np / no)) / pi(), 5) AS angle, round(r, 5) AS pearson, 1.0::DOUBLE AS matched_coverage, 1.0::DOUBLE AS pred_coverage, 0.0::DOUBLE AS unmatched FROM a WHERE r IS NOT NULL AND NOT isnan(r)"
)
def q_spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature kernel on spectra whose peaks lie at the b ions of each part's name."""
    s, none = F.col("s"), F.lit(None).cast("string")
    places = F.sequence(F.lit(1), F.length("s") - 1)
    from ionquill.functions import peptides as P

    predicted = F.transform(places, lambda i: 1.0 / (1 + i % 5))
    rows = fitting(spark, sf_dir).select(
        "p_partkey", s.alias("peptide"), none.alias("ptm_seq"), F.lit(2).alias("charge"), F.transform(P.ion_masses(s, none, {}, "b"), lambda m: m + PROTON).alias("mzs"),
        F.transform(places, lambda i: 0.1 + (F.col("p_partkey") * 7 + i * 13) % 10).alias("intensities"), F.transform(places, lambda i: F.concat(F.lit("b"), text(i))).alias("ions"), predicted.alias("predicted"),
    )
    out = spectra_ops.spectral_features(rows, spectra_ops.Settings({}, 0.001), minimal=False)
    rounded = lambda c, n: F.round(c, 5).alias(n)
    return out.where("pearsonR > -1").select("p_partkey", rounded("spectralAngle", "angle"), rounded("pearsonR", "pearson"), rounded("matchedCoverage", "matched_coverage"), rounded("predCoverage", "pred_coverage"), rounded("nNotMatchableDivFrags", "unmatched"))


@query(
    PEPTIDES + f", r AS (SELECT p_partkey, unnest(string_split(s, '')) AS a FROM p WHERE length(s) BETWEEN 5 AND 30), m AS (SELECT p_partkey, round(sum({_mass_case('a')}), 2) AS mw FROM r GROUP BY 1)"
    " SELECT a.p_partkey AS p_partkey, count(*) AS n_isobaric FROM m a JOIN m b ON a.mw = b.mw WHERE a.p_partkey <> b.p_partkey GROUP BY 1"
)
def q_isobaric_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionquill.operators.relational import isobaric_counts
    from ionquill.plans.epitopes import residue_mass

    m = fitting(spark, sf_dir).select("p_partkey", residue_mass(F.col("s")).alias("mw"))
    return isobaric_counts(m, "p_partkey", "mw")


