"""Queries of the projections, modifications, joins and calibrations that PSM tables go through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill.functions import arrays as A
from ionquill.functions import peptides as P
from ionquill.operators import columns as C
from ionquill.operators import relational as R
from ionquill.operators import statistics as S
from ionquill.plans import epitopes, rescore
from ionquill.plans.format_queries import CODE, oxidised
from ionquill.plans.io_queries import FITTING, ORDERS, fitting, searched, text
from ionquill.plans.registry import query, table

# Projections


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'one' WHEN 'SMALL' THEN 'two' ELSE p_type END AS kind, coalesce(CASE WHEN p_size > 25 THEN p_brand END, '') AS brand FROM part")
def q_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values replaced by a map, and nulls of text as empty strings."""
    p = table(spark, sf_dir, "part").select("p_partkey", C.replaced(F.col("p_type"), {"PROMO": "one", "SMALL": "two"}).alias("kind"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand"))
    return C.filled_strings(p, ["brand"])


@query(
    "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS a, CASE WHEN l_discount > 0.05 THEN l_discount END AS b, l_tax AS c FROM lineitem)"
    " SELECT l_orderkey, l_linenumber, l_partkey, least(a, b, c) AS low, greatest(a, b, c) AS high, round(a + coalesce(b, 0) + c, 6) AS total, (2 + (b IS NOT NULL)::INTEGER)::INTEGER AS n, round((a + coalesce(b, 0) + c) / (2 + (b IS NOT NULL)::INTEGER), 6) AS mean FROM c"
)
def q_across_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min, max, sum, count and mean over columns of a row, nulls left out."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("a"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("b"), F.col("l_tax").alias("c"))
    own = ["a", "b", "c"]
    rounded = lambda w: F.round(C.across(own, w), 6)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", C.across(own, "min").alias("low"), C.across(own, "max").alias("high"), rounded("sum").alias("total"), C.across(own, "count").alias("n"), rounded("mean").alias("mean"))


@query("SELECT p_partkey, (p_type = 'PROMO')::INTEGER AS accession_PROMO, (p_type = 'SMALL')::INTEGER AS accession_SMALL, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 END AS stratum, round(p_retailprice * CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0.7 END, 4) AS weighted FROM part")
def q_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 column for each stratum, the stratum back from those, and scores weighted by it."""
    from ionquill.operators.proteome import accession_group, from_one_hot, one_hot, stratum_weighted

    names = ["PROMO", "SMALL"]
    p = table(spark, sf_dir, "part").withColumn("g", accession_group(F.col("p_type"), names, ";", unmatched=9))
    hot = p.select("p_partkey", "p_retailprice", "g", *one_hot(F.col("g"), names))
    return hot.select("p_partkey", "accession_PROMO", "accession_SMALL", from_one_hot(names).alias("stratum"), F.round(stratum_weighted(F.col("p_retailprice"), F.col("g")), 4).alias("weighted"))


@query("SELECT name FROM (SELECT 'l_quantity' AS name, min(l_quantity) <> max(l_quantity) AS ok FROM lineitem UNION ALL SELECT 'one', false UNION ALL SELECT 'l_discount', min(l_discount) <> max(l_discount) FROM lineitem) WHERE ok")
def q_informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that have more than one value, less those that are excluded."""
    from ionquill.operators.features import informative

    l = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", F.lit(1).alias("one"))
    return spark.createDataFrame([(c,) for c in informative(l, ["l_quantity", "one", "l_discount", "l_tax"], ("l_tax",))], "name string")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CASE WHEN o_totalprice > 200000 AND o_custkey > 50 THEN 1 ELSE -1 END ELSE 0 END AS metric FROM orders")
def q_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.metric(label, F.col("o_totalprice"), F.col("o_custkey"), 200000, 50).alias("metric"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 1e6 < 0.05 AND o_custkey % 100 - 50 >= 0.5 THEN 'Upregulated' WHEN o_totalprice / 1e6 < 0.05 AND o_custkey % 100 - 50 <= -0.5 THEN 'Downregulated' ELSE 'Not significant' END AS regulation FROM orders")
def q_regulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.regulation(F.col("o_custkey") % 100 - 50, F.col("o_totalprice") / 1e6).alias("regulation"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS best FROM lineitem")
def q_max_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", S.largest_of(["l_orderkey"], "l_extendedprice").alias("best"))


@query("SELECT vec_id, embedding[3]::DOUBLE AS third, embedding[9]::DOUBLE AS ninth, 64::INTEGER AS n FROM embeddings")
def q_map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as a map by ion names, looked up by name."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    m = A.as_map(F.transform(F.sequence(F.lit(1), F.size("v")), lambda k: F.concat(F.lit("b"), k.cast("string"))), F.col("v"))
    return e.select("vec_id", m.alias("m")).select("vec_id", F.col("m")["b3"].alias("third"), F.col("m")["b9"].alias("ninth"), F.size("m").alias("n"))


# Modifications


@query(FITTING + " SELECT p_partkey, CASE WHEN regexp_matches(s, '[CM]') THEN '0.' || replace(replace(regexp_replace(s, '[^CM]', '0', 'g'), 'C', '1'), 'M', '2') || '.0' END AS code, '3.' || replace(regexp_replace(s, '[^M]', '0', 'g'), 'M', '2') || '.0' AS capped FROM f")
def q_fixed_modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed modification at every cysteine, and one at the N-terminus."""
    f = fitting(spark, sf_dir).withColumn("code", oxidised(F.col("s")))
    return f.select("p_partkey", P.with_fixed(F.col("s"), F.col("code"), "C", 1).alias("code"), P.with_fixed(F.col("s"), F.col("code"), "N-term", 3).alias("capped"))


@query(
    "SELECT name AS \"Name\", CASE name WHEN 'Oxidation (M)' THEN 2 WHEN 'Phospho (S)' THEN 6 ELSE 9 END AS \"Identifier\", CASE name WHEN 'Oxidation (M)' THEN 15.994915 WHEN 'Phospho (S)' THEN 79.966331 ELSE 0.0 END::DOUBLE AS \"Delta\", true AS \"isVar\""
    " FROM (SELECT DISTINCT CASE p_type WHEN 'PROMO' THEN 'Oxidation (M)' WHEN 'SMALL' THEN 'Phospho (S)' WHEN 'ECONOMY' THEN 'Unmodified' ELSE p_type END AS name FROM part) WHERE name <> 'Unmodified'"
)
def q_modification_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionquill.sources.searches import modification_table

    names = table(spark, sf_dir, "part").select(C.replaced(F.col("p_type"), {"PROMO": " Oxidation (M)", "SMALL": "Phospho (S)", "ECONOMY": "Unmodified"}).alias("name"))
    return modification_table(spark, names)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'y' ELSE 'b' END AS series, p_size::INTEGER AS position, (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey % 3 + 1 END)::INTEGER AS charge, (CASE WHEN p_size % 2 = 0 THEN 60 - p_size ELSE p_size END)::INTEGER AS site FROM part")
def q_ion_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series, position and charge of an ion's name, and the bond that it breaks."""
    z = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("^"), text(F.col("p_partkey") % 3 + 1)))
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "y").otherwise("b"), text(F.col("p_size")), z)
    p = table(spark, sf_dir, "part").select("p_partkey", P.ion_parts(name).alias("ion"), P.cleavage_site(name, F.lit(60)).alias("site"))
    return p.select("p_partkey", "ion.series", "ion.position", "ion.charge", "site")


@query(FITTING + " SELECT p_partkey, '0.' || lpad('', (i - 1)::INTEGER, '0') || '2' || lpad('', (length(s) - i)::INTEGER, '0') || '.0' AS code FROM f, range(1, 31) t(i) WHERE i <= length(s) AND s[i] = 'M'")
def q_oxidation_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways to oxidise one methionine."""
    return fitting(spark, sf_dir).select("p_partkey", F.explode(epitopes.oxidation_placements(F.col("s"), F.lit(1))).alias("code"))


_AT = "list_filter(range(1, length(s) + 1), lambda i: s[i] IN ('C', 'M'))"


@query(
    FITTING + f" SELECT p_partkey, len({_AT}) || array_to_string(list_transform({_AT}, lambda i: '/' || (i + 1) || CASE WHEN s[i] = 'C' THEN ',C,Carbamidomethyl' ELSE ',M,Oxidation' END), '') AS numbered,"
    f" array_to_string(list_transform({_AT}, lambda i: CASE WHEN s[i] = 'C' THEN 'Carbamidomethyl@C' ELSE 'Oxidation@M' END || (i + 1)), '; ') AS marked FROM f"
)
def q_modification_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered, marked = C.modification_strings(P.encoded(F.regexp_replace("s", "M", "M(ox)")))
    return fitting(spark, sf_dir).select("p_partkey", numbered.alias("numbered"), marked.alias("marked"))


@query(ORDERS + " SELECT o_orderkey AS scan, s AS peptide FROM o WHERE NOT contains(s, 'M') AND NOT contains(s, 'C')")
def q_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSMs without modifications that nothing is known of, and without bare cysteines."""
    psms = searched(spark, sf_dir).select(F.col("o_orderkey").alias("scan"), F.col("s").alias("peptide"), oxidised(F.col("s")).alias("ptm_seq"))
    return rescore.eligible(psms, rescore.default_options(unknown="2", without_cysteine=True)).select("scan", "peptide")


# Joins and sets


@query(ORDERS + ", k AS (SELECT replace(s, 'M', 'M(ox)') AS m, max(p_partkey) AS irt FROM f WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT o_orderkey AS scan, s AS peptide, irt, 64::INTEGER AS n_peaks, o_custkey + 0.5::DOUBLE AS rt FROM o JOIN k ON replace(s, 'M', 'M(ox)') = m JOIN embeddings ON vec_id = o_orderkey")
def q_psm_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSMs with their prediction (by modified sequence and charge) and their spectrum (by file and scan)."""
    psms = searched(spark, sf_dir).select(
        F.lit("run").alias("source"), F.col("o_orderkey").alias("scan"), F.col("s").alias("peptide"), oxidised(F.col("s")).alias("ptm_seq"), F.lit(2).alias("charge"), (F.col("o_custkey") + 0.5).alias("retentionTime")
    )
    scans = table(spark, sf_dir, "embeddings").select(F.lit("run").alias("source"), F.col("vec_id").alias("scan"), F.col("embedding").alias("mzs"), F.col("embedding").alias("intensities"), F.lit(1.0).alias("retentionTime"))
    f = fitting(spark, sf_dir).where("p_partkey % 2 = 0")
    known = f.select("s", F.col("s").alias("peptide"), F.regexp_replace("s", "M", "M(ox)").alias("modified_sequence"), F.lit(2).alias("charge"), F.lit(30.0).alias("collisionEnergy"), F.col("p_partkey").alias("iRT"), F.array(F.lit("b1")).alias("ions"), F.array(F.lit(1.0)).alias("intensities")).drop("s")
    met = rescore.joined(psms, scans, known)
    return met.select("scan", "peptide", F.col("iRT").alias("irt"), F.size("mzs").alias("n_peaks"), F.col("retentionTime").alias("rt"))


@query("SELECT o_orderkey AS scan, o_orderpriority AS peptide FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL OR replace(o_orderpriority, 'I', 'L') = replace(c_mktsegment, 'I', 'L') OR o_totalprice / 1e6 > c_acctbal / 1e4")
def q_contaminants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSMs that no better contaminant of their scan explains."""
    o = table(spark, sf_dir, "orders").select(F.lit("run").alias("source"), F.col("o_custkey").alias("scan"), F.col("o_orderkey"), F.col("o_orderpriority").alias("peptide"), (F.col("o_totalprice") / 1e6).alias("spectralAngle"))
    c = table(spark, sf_dir, "customer").select(F.lit("run").alias("source"), F.col("c_custkey").alias("scan"), F.col("c_mktsegment").alias("peptide"), (F.col("c_acctbal") / 1e4).alias("spectralAngle"))
    return epitopes.without_contaminants(o, c).select(F.col("o_orderkey").alias("scan"), "peptide")


@query("WITH b AS (SELECT l_orderkey AS scan, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) SELECT o_orderkey AS scan, round(o_totalprice, 2) AS score FROM orders LEFT JOIN b ON scan = o_orderkey WHERE o_totalprice > coalesce(best, -100000.0)")
def q_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spliced PSMs that beat the best competitor of their scan."""
    o = table(spark, sf_dir, "orders").select(F.lit("run").alias("source"), F.col("o_orderkey").alias("scan"), F.col("o_totalprice").alias("reScore"))
    l = table(spark, sf_dir, "lineitem").select(F.lit("run").alias("source"), F.col("l_orderkey").alias("scan"), F.col("l_extendedprice").alias("compScore"))
    return epitopes.validated(o, l).select("scan", F.round("reScore", 2).alias("score"))


@query("SELECT n_name, p_type, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def q_chained_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("n_name", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, c_mktsegment AS name, c_acctbal AS score FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def q_union_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables that lack columns or have other types, in the first one's schema."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("score"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").cast("string").alias("score"), F.col("s_suppkey").alias("id"), F.lit(1).alias("other"))
    return R.union_aligned(c, s)


@query("SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price FROM orders")
def q_split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table split by a condition, one part changed, both put together again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    one, rest = R.split(o, F.col("o_orderstatus") == "F")
    return one.withColumn("price", F.col("price") * 2).unionByName(rest).select("o_orderkey", F.round("price", 2).alias("price"))


@query("SELECT 'same' AS test, true AS holds UNION ALL SELECT 'changed', false")
def q_same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two tables hold the same rows equally often."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return spark.createDataFrame([("same", R.same_rows(c, c.orderBy("c_nationkey"))), ("changed", R.same_rows(c, c.withColumn("c_nationkey", F.col("c_nationkey") + 1)))], "test string, holds boolean")


# Quantities, times and spectra


@query("SELECT user_id::VARCHAR AS peptide, CASE WHEN event_type IN ('click', 'view') THEN 's1' ELSE 's2' END AS sample, event_type IN ('click', 'view') AS infected, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2, 3")
def q_sample_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the files of each sample."""
    from ionquill.operators.quantification import sample_means

    e = table(spark, sf_dir, "events").select(text(F.col("user_id")).alias("peptide"), F.col("event_type").alias("source"), F.col("value").alias("norm"))
    kinds = e.select("source").distinct().select("source", F.when(F.col("source").isin("click", "view"), "s1").otherwise("s2").alias("sample"), F.col("source").isin("click", "view").alias("isInfected"))
    return sample_means(e, kinds).select("peptide", "sample", F.col("isInfected").alias("infected"), F.round("value", 6).alias("mean"))


@query(
    "WITH r AS (SELECT user_id, event_type, value AS raw, 0.9 AS ratio, log2(nullif(value, 0)) AS clean, event_id FROM events), m AS (SELECT event_type, median(clean) AS m FROM r GROUP BY 1)"
    " SELECT event_id, round(clean - m + (SELECT median(clean) FROM r), 6) AS norm FROM r JOIN m USING (event_type)"
)
def q_quant_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log2 of valid quantities with the files' medians made equal."""
    from ionquill.operators.quantification import normalised

    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.col("value").alias("raw"), F.lit(0.9).alias("ratio"), F.lit(1.0).alias("idp"))
    return normalised(e).select("event_id", F.round("norm", 6).alias("norm"))


@query(
    "WITH a AS (SELECT o_orderkey AS scan, (o_orderkey % 50 + 900) / 1.0 AS m, (o_custkey % 300)::DOUBLE AS t FROM orders), b AS (SELECT (p_partkey % 300)::DOUBLE AS t, (p_size + 900)::DOUBLE AS m, p_retailprice AS i FROM part)"
    " SELECT scan, round(coalesce(sum(b.t * i) / nullif(sum(i), 0), any_value(a.t)), 5) AS rt FROM a LEFT JOIN b ON abs(b.t - a.t) < 60 AND abs(b.m - a.m) < 0.5 GROUP BY scan"
)
def q_spread_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of precursors as intensity-weighted means over the survey scans nearby."""
    from ionquill.sources.spectra import spread_retention_times

    ms2 = table(spark, sf_dir, "orders").select(F.lit("run").alias("source"), F.col("o_orderkey").alias("scan"), (F.col("o_orderkey") % 50 + 900.0).alias("precursor"), (F.col("o_custkey") % 300).cast("double").alias("retentionTime"))
    ms1 = table(spark, sf_dir, "part").select(F.lit("run").alias("source"), (F.col("p_partkey") % 300).cast("double").alias("retentionTime"), F.array((F.col("p_size") + 900).cast("double")).alias("mzs"), F.array("p_retailprice").alias("intensities"))
    return spread_retention_times(ms2, ms1, 60.0, 0.5).select("scan", F.round("retentionTime", 5).alias("rt"))


@query(
    "WITH e AS (SELECT DISTINCT user_id, (event_id % 10)::INTEGER AS f, epoch(ts) / 3600.0 AS x, value AS y FROM events), t AS (SELECT user_id, k::INTEGER AS fold, x, y FROM e, range(0, 10) r(k) WHERE f <> k),"
    " s AS (SELECT a.user_id AS user_id, a.fold AS fold, median((b.y - a.y) / (b.x - a.x)) AS slope FROM t a JOIN t b ON a.user_id = b.user_id AND a.fold = b.fold AND b.x > a.x GROUP BY 1, 2)"
    " SELECT t.user_id AS user_id, t.fold AS fold, round(any_value(slope), 5) AS slope, round(median(y - slope * x), 2) AS intercept, count(*) AS n FROM t JOIN s ON t.user_id = s.user_id AND t.fold = s.fold GROUP BY 1, 2"
)
def q_time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of observed over predicted time, ten for each key, each learned from the points of the other nine folds."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 10).cast("int").alias("f"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0).alias("x"), F.col("value").alias("y")).distinct()
    out = S.fold_lines(e, ["user_id"], "x", "y", F.col("f"))
    return out.select("user_id", "fold", F.round("slope", 5).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query("SELECT vec_id, len(list_filter(v, lambda x: x <= 0.1 AND x >= -0.1))::INTEGER AS n_left, round(list_sum(list_filter(v, lambda x: x <= 0.1 AND x >= -0.1)), 5) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)")
def q_not_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that belong to none of the matched groups."""
    from ionquill.operators.spectra import not_matched

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    left = not_matched(F.col("v"), F.filter("v", lambda x: x > 0.1), F.filter("v", lambda x: x < -0.1))
    return e.select("vec_id", left.alias("left")).select("vec_id", F.size("left").alias("n_left"), F.when(F.size("left") > 0, F.round(A.total(F.col("left")), 5)).alias("total"))


@query(
    "WITH r AS (SELECT vec_id, (vec_id % 40 + 10) AS n, i, CASE WHEN i >= vec_id % 40 + 10 OR i % 3 + 1 > 2 THEN -1.0 ELSE greatest(embedding[i]::DOUBLE, 0.0) END AS x FROM embeddings, range(1, 65) t(i)), m AS (SELECT vec_id, max(x) AS top FROM r GROUP BY 1)"
    " SELECT vec_id, i::INTEGER AS position, round(CASE WHEN x > 0 AND top > 0 THEN x / top ELSE x END, 6) AS intensity FROM r JOIN m USING (vec_id)"
)
def q_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor's raw output: impossible ions marked, negatives 0, the largest 1."""
    from ionquill.operators.spectra import sanitised

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    places = F.sequence(F.lit(1), F.lit(64))
    x = sanitised(F.col("v"), F.col("vec_id") % 40 + 10, F.lit(2), places, F.transform(places, lambda i: i % 3 + 1))
    return e.select("vec_id", F.posexplode(x).alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("position"), F.round("x", 6).alias("intensity"))
