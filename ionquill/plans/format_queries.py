"""Queries of the remaining readers and writers, each format made from the tables, written, and read back."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill import config, sinks
from ionquill.constants import STANDARD_MODIFICATIONS
from ionquill.functions import peptides as P
from ionquill.functions.registered import register
from ionquill.plans.io_queries import FITTING, ORDERS, fitting, headed, searched, text, written
from ionquill.plans.registry import query, table
from ionquill.sources import searches, spectra, tables
from ionquill.storage import new_path

CODE = "CASE WHEN contains(s, 'M') THEN '0.' || replace(regexp_replace(s, '[^M]', '0', 'g'), 'M', '2') || '.0' END"
NO_CODE = "lpad('', length(s)::INTEGER, '0')"


def oxidised(s: Column) -> Column:
    """Code of a sequence with every methionine oxidised; null without one."""
    body = F.regexp_replace(F.regexp_replace(s, "[^M]", "0"), "M", "2")
    return F.when(F.contains(s, F.lit("M")), F.concat(F.lit("0."), body, F.lit(".0")))


def headed_text(df: DataFrame, value: Column, head: str, label: str) -> str:
    """Path of text files that each begin with ``head``, which takes a batch's first row along."""
    import pyarrow as pa

    def run(batches):
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines and first:
                lines[0], first = f"{head}\n{lines[0]}", False
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    path = new_path(df.sparkSession, label)
    df.select(value.alias("value")).mapInArrow(run, "value string").write.text(path)
    return path


@query(ORDERS + f" SELECT o_orderkey AS scan, 'run' AS source, s AS peptide, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS label, {CODE} AS code, 'C' || o_custkey AS proteins, round(o_totalprice, 2) AS score, 0.5::DOUBLE AS mass_diff FROM o")
def q_source_mascot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits table of a sectioned CSV, scan and file from the scans' titles."""
    rows = searched(spark, sf_dir).select(
        F.lit(1).alias("prot_hit_num"), F.concat(F.lit("C"), text(F.col("o_custkey"))).alias("prot_acc"), F.when(F.col("o_orderstatus") == "F", "Reversed sequence").otherwise("a, \"b\"").alias("prot_desc"),
        F.lit(900.5).alias("pep_exp_mr"), F.lit("2+").alias("pep_exp_z"), F.lit(900.0).alias("pep_calc_mr"), F.lit(0).alias("pep_miss"), F.col("o_totalprice").alias("pep_score"), F.col("s").alias("pep_seq"),
        oxidised(F.col("s")).alias("pep_var_mod_pos"), F.concat(F.lit("File:~run.raw~, NativeID:~scan="), text(F.col("o_orderkey")), F.lit("~")).alias("pep_scan_title"),
    )
    got = searches.read_mascot(spark, headed(rows, "mascot", ","))
    return got.select("scan", "source", "peptide", F.col("Label").alias("label"), F.col("ptm_seq").alias("code"), "proteins", F.round("engineScore", 2).alias("score"), F.round("massDiff", 3).alias("mass_diff"))


@query(
    "SELECT o_orderkey AS item, o_orderkey AS scan, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'f' || o_orderkey % 2 ELSE 'own' END AS source,"
    " CASE WHEN o_orderkey % 3 <> 0 THEN round(o_custkey + 0.5, 2) END AS rt FROM orders"
)
def q_scan_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, file and time from titles of three styles."""
    key, rt = text(F.col("o_orderkey")), F.concat(F.lit(" (rt="), text(F.col("o_custkey") + 0.5), F.lit(")"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    styles = [
        (None, F.concat(F.lit('File:"a.raw", scan='), key), {}),
        ("mascotDistiller", F.concat(F.lit("1: Scan "), key, rt, F.lit(" from file ["), text(F.col("o_orderkey") % 2), F.lit("]")), {"sources": ["f0", "f1"]}),
        ("distiller", F.concat(F.lit("2: Scan "), key, rt), {"source": "own"}),
    ]
    out = None
    for k, (style, title, more) in enumerate(styles):
        part = o.where(F.col("o_orderkey") % 3 == k)
        found = searches.scan_title(title, style, **more)
        one = part.select(F.col("o_orderkey").alias("item"), found["scan"].alias("scan"), found["source"].alias("source"), F.round(found["retentionTime"], 2).alias("rt"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    ORDERS + f" SELECT o_orderkey AS scan, s AS peptide, {CODE} AS code, round((190 + o_custkey % 50) / 3.0, 4) AS score, least(60.0, 50 + o_custkey % 50)::DOUBLE AS delta, -0.0146::DOUBLE AS mass_diff FROM o"
)
def q_source_peaks_de_novo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = searched(spark, sf_dir).select(
        F.lit(2).alias("z"), F.concat(text(50 + F.col("o_custkey") % 50), F.lit(" 60 80")).alias("local confidence (%)"), F.lit(899.0).alias("Mass"), F.lit(450.5).alias("m/z"),
        F.regexp_replace("s", "M", "M(+15.99)").alias("Peptide"), F.lit(5.5).alias("RT"), F.concat(F.lit("F1:"), text(F.col("o_orderkey"))).alias("Scan"), F.lit(1).alias("Denovo score"), F.lit("a.raw").alias("Source File"),
    )
    got = searches.read_peaks_de_novo(spark, headed(rows, "denovo", ","))
    return got.select("scan", "peptide", F.col("ptm_seq").alias("code"), F.round("engineScore", 4).alias("score"), F.col("deltaScore").alias("delta"), F.round("massDiff", 4).alias("mass_diff"))


@query(ORDERS + f" SELECT o_orderkey AS scan, 'run' AS source, replace(s, 'I', 'L') AS peptide, {CODE} AS code, round(o_totalprice, 2) AS score, 0.25::DOUBLE AS mass_diff, 0.5::DOUBLE AS least FROM o")
def q_source_mztab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSM lines of mzTab files by the header that each file has."""
    head = "MTD\tms_run[1]-location\tfile:///data/run.mzML\nPSH\tsequence\tsearch_engine_score[1]\texp_mass_to_charge\tcalc_mass_to_charge\topt_ms_run[1]_aa_scores\tspectra_ref\tcharge"
    line = F.concat_ws("\t", F.lit("PSM"), F.regexp_replace("s", "M", "M+15.995"), text(F.col("o_totalprice")), F.lit("450.75"), F.lit("450.5"), F.lit("0.9,0.5,0.7"), F.concat(F.lit("ms_run[1]:index="), text(F.col("o_orderkey"))), F.lit("2"))
    got = searches.read_mztab(spark, headed_text(searched(spark, sf_dir), line, head, "mztab"))
    return got.select("scan", "source", "peptide", F.col("ptm_seq").alias("code"), F.round("engineScore", 2).alias("score"), F.round("massDiff", 4).alias("mass_diff"), F.col("deltaScore").alias("least"))


@query(ORDERS + f" SELECT o_orderkey AS scan, 'run' AS source, s AS peptide, {CODE} AS code FROM o WHERE o_totalprice / 2e7 < 0.01")
def q_source_ssl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifications below a q-value written for Skyline and read again."""
    found = searched(spark, sf_dir).select(
        F.lit("run.raw").alias("source"), F.col("o_orderkey").alias("scan"), F.lit(2).alias("charge"), F.regexp_replace("s", "M", "M[+16.0]").alias("modifiedSequence"),
        (F.col("o_totalprice") / 2e7).alias("qValue"), F.lit(5.5).alias("retentionTime"),
    )
    path = new_path(spark, "ssl")
    sinks.write_ssl(found, path)
    return searches.read_ssl(spark, path).select("scan", "source", "peptide", F.col("ptm_seq").alias("code"))


@query("SELECT p_partkey::VARCHAR AS peptide, least(round(p_retailprice, 2), round(p_retailprice * 3 - 2000, 2)) AS ic50 FROM part WHERE p_size > 10")
def q_source_ic50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least affinity over one file an allele, of peptides that all files have."""
    p = table(spark, sf_dir, "part")
    one = p.select(F.col("p_partkey").alias("peptide"), F.round("p_retailprice", 2).alias("ic50"))
    two = p.where("p_size > 10").select(F.col("p_partkey").alias("peptide"), F.round(F.col("p_retailprice") * 3 - 2000, 2).alias("ic50"))
    return tables.read_ic50(spark, {"A": headed(one, "ic50", ","), "B": headed(two, "ic50", ",")})


@query(ORDERS + " SELECT 'my_run' AS source, o_orderkey AS scan, s AS peptide, replace(s, 'M', 'M[+16.0]') AS modified, round(o_totalprice, 2) AS score, round(o_totalprice / 1e6, 6) AS q_value, 'C' || o_custkey AS proteins FROM o")
def q_source_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rescorer's table: its ids are put together on writing and taken apart on reading."""
    s = searched(spark, sf_dir)
    modified = P.mass_tagged(F.col("s"), oxidised(F.col("s")), STANDARD_MODIFICATIONS)
    rows = s.select(
        P.psm_id(F.lit("my_run"), F.col("o_orderkey"), modified).alias("PSMId"), F.col("o_totalprice").alias("score"), F.round(F.col("o_totalprice") / 1e6, 6).alias("q-value"), F.lit(0.1).alias("posterior_error_prob"),
        F.concat(F.lit("-."), F.col("s"), F.lit(".-")).alias("peptide"), F.concat(F.lit("C"), text(F.col("o_custkey"))).alias("proteinIds"),
    )
    got = tables.read_rescored(spark, headed(rows, "rescored", "\t"))
    ident = P.split_psm_id(F.col("psmId"))
    return got.select(ident["source"].alias("source"), ident["scan"].alias("scan"), "peptide", ident["modifiedSequence"].alias("modified"), F.round("score", 2).alias("score"), F.round("qValue", 6).alias("q_value"), "proteins")


@query("SELECT vec_id AS scan, label FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def q_scan_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectra that search results refer to; sources lose their suffix on the way."""
    psms = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("run.raw").alias("source"), F.col("o_orderkey").alias("scan"))
    scans = table(spark, sf_dir, "embeddings").select(F.lit("run").alias("source"), F.col("vec_id").alias("scan"), "label")
    return spectra.scans_for(psms, scans).select("scan", "label")


CONFIG = {"experimentTitle": "made", "outputFolder": "out", "searchEngine": "maxquant", "scansFolder": "scans", "scansFormat": "mgf", "searchResults": "msms.txt", "falseDiscoveryRate": 0.05}


@query("SELECT * FROM (VALUES ('experiment_title', 'made'), ('false_discovery_rate', '0.05'), ('scans_format', 'mgf'), ('search_engine', 'maxquant'), ('search_results', '(''msms.txt'',)')) t(name, value)")
def q_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from a YAML file, names in snake case, lists as tuples; the file is the driver's own and small."""
    handle, path = tempfile.mkstemp(suffix=".yml")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.writelines(f"{k}: {v}\n" for k, v in CONFIG.items())
    settings = config.load(path)
    os.remove(path)
    names = ["experiment_title", "false_discovery_rate", "scans_format", "search_engine", "search_results"]
    return spark.createDataFrame([(n, str(getattr(settings, n))) for n in names], "name string, value string")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS position, 'file_' || n_nationkey AS name FROM nation")
def q_source_distiller_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files that a log names, in its order."""
    line = F.concat(F.lit('loading "C:\\data\\file_'), text(F.col("n_nationkey")), F.lit('.raw" again file_'), text(F.col("n_nationkey")), F.lit(".raw"))
    log = table(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("log"))
    names = tables.read_distiller_log(spark, written(log, F.col("log"), "log"))
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


@query(
    "WITH w AS (SELECT n_name AS feature, ((n_nationkey * 7) % 25 + (n_nationkey * 7 + 3) % 25 + (n_nationkey * 7 + 6) % 25) / 3.0 AS weight FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY weight, feature) AS up, row_number() OVER (ORDER BY weight DESC, feature) AS down FROM w)"
    " SELECT feature, round(weight, 6) AS weight, CASE WHEN up <= 3 THEN 'bottom' ELSE 'top' END AS side FROM r WHERE up <= 3 OR down <= 3"
)
def q_source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three models; the three largest and least features by their mean."""
    n = table(spark, sf_dir, "nation")
    cells = lambda of: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", of.alias("x")))), lambda r: r["x"]), "\t")
    row = n.agg(cells(F.col("n_name")).alias("names"), *[cells(text((F.col("n_nationkey") * 7 + 3 * k) % 25)).alias(f"w{k}") for k in range(3)])
    whole = F.concat(F.lit("# a comment"), *[x for k in range(3) for x in (F.lit("\n"), F.col("names"), F.lit("\n"), F.col(f"w{k}"), F.lit("\n"), F.col(f"w{k}"))])
    return tables.extreme_weights(tables.read_weights(spark, written(row, whole, "weights"))).withColumn("weight", F.round("weight", 6))


@query(
    FITTING + " SELECT DISTINCT s AS peptide, 2::INTEGER AS charge, CASE WHEN contains(s, 'M') THEN array_to_string(list_transform(list_filter(range(1, length(s) + 1), lambda i: s[i] = 'M'), lambda i: i || '|Oxidation'), '|') ELSE '-' END AS modifications FROM f"
)
def q_sink_preprec(spark: SparkSession, sf_dir: str) -> DataFrame:
    psms = fitting(spark, sf_dir).select(F.col("s").alias("peptide"), oxidised(F.col("s")).alias("ptm_seq"), F.lit(2).alias("charge"))
    path = new_path(spark, "preprec")
    sinks.write_preprec(psms, path, {2: "Oxidation"})
    return spark.read.csv(path, sep=" ", header=True, schema="spec_id string, modifications string, peptide string, charge int").drop("spec_id")


@query(FITTING + ", d AS (SELECT DISTINCT s, length(s)::INTEGER AS length FROM f) SELECT s AS peptide, length, ((row_number() OVER (PARTITION BY length ORDER BY s) - 1) // 500)::INTEGER AS batch FROM d")
def q_sink_binding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "batches")
    sinks.write_binding_batches(fitting(spark, sf_dir).select(F.col("s").alias("peptide")), path)
    return spark.read.schema("value string, length int, batch int").text(path).select(F.col("value").alias("peptide"), "length", "batch")


@query(
    ORDERS + " SELECT 'run_' || o_orderkey || '_' || replace(s, 'M', 'M[+16.0]') AS id, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS label, o_orderkey + 5 AS scannr, round(o_totalprice, 2) AS price, length(s)::INTEGER AS size, '-.' || replace(s, 'M', 'M[+16.0]') || '.-' AS peptide, 'C' || o_custkey AS proteins FROM o"
)
def q_sink_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table by source, and a rescorer's input from it."""
    rows = searched(spark, sf_dir).select(
        F.lit("run").alias("source"), F.col("o_orderkey").alias("scan"), F.col("s").alias("peptide"), oxidised(F.col("s")).alias("ptm_seq"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("Label"),
        (F.col("o_orderkey") + 5).alias("scannr"), F.round("o_totalprice", 2).alias("price"), F.length("s").alias("size"), F.concat(F.lit("C"), text(F.col("o_custkey"))).alias("proteins"),
    )
    table_path, path = new_path(spark, "features"), new_path(spark, "rescorer")
    sinks.write_features(rows, table_path)
    sinks.write_rescorer_input(spark.read.parquet(table_path), path, ["price", "size"], STANDARD_MODIFICATIONS)
    return spark.read.csv(path, sep="\t", header=True, schema="id string, label int, scannr long, price double, size int, peptide string, proteins string")


@query("SELECT o_custkey::VARCHAR AS peptide, count(*) AS \"nPsms\", max((o_orderstatus = 'F')::INTEGER) AS \"F\", max((o_orderstatus = 'O')::INTEGER) AS \"O\" FROM orders GROUP BY 1")
def q_sink_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides left out, with the files that hold them, written beside other result tables."""
    o = table(spark, sf_dir, "orders").select(text(F.col("o_custkey")).alias("peptide"), F.col("o_orderstatus").alias("source"))
    folder = new_path(spark, "results")
    sinks.write_tables(folder, {"excluded": sinks.excluded_table(o, ["F", "O"])})
    return spark.read.parquet(f"{folder}/excluded")


@query("SELECT vec_id, round(1 - 2 * acos(greatest(-1, least(1, d / greatest(n * m, 1e-300)))) / pi(), 5) AS angle FROM (SELECT vec_id, list_inner_product(v, w) AS d, sqrt(list_inner_product(v, v)) AS n, sqrt(list_inner_product(w, w)) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS w FROM embeddings))")
def q_registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text that calls the library's functions."""
    register(spark)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = e.select("vec_id", F.transform("v", lambda x: F.abs(x)).alias("v"), F.transform("v", lambda x: x * x).alias("w"))
    return e.selectExpr("vec_id", "round(spectral_angle(v, w), 5) AS angle")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream and counted by hour; the stream ends when all files are read."""
    from ionquill.streaming.arrivals import windowed_counts

    out = new_path(spark, "windows")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_with_parent(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windowed_counts(events, "ts", ["event_type"])
    write = lambda batch, number: batch.write.mode("overwrite").parquet(out)
    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    start = F.col("start").cast("timestamp_ntz") if dict(table(spark, sf_dir, "events").dtypes)["ts"] == "timestamp_ntz" else F.col("start")
    return spark.read.parquet(out).select(start.alias("start"), "event_type", "n")


def _with_parent(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder that holds one table's files, as streams read folders: the table's own, or a copy of a table that is one file."""
    copy = new_path(spark, name)
    table(spark, sf_dir, name).write.parquet(copy)
    return copy


@query("SELECT 'f' || (o_orderkey % 4) AS source, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY 1")
def q_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive are each read once, into a table by source."""
    from ionquill.streaming.arrivals import appended

    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), text(F.col("o_orderkey") % 4)).alias("source"), F.col("o_totalprice").alias("price"))
    folder, out = headed(rows, "arrived", ","), new_path(spark, "appended")
    read = lambda s, paths: s.read.csv(paths, header=True, schema="source string, price double")
    appended(spark, folder, read, out, new_path(spark, "stream"), pattern="*.csv").awaitTermination()
    return spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 0).alias("total"))
