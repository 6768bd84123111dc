"""Queries of the target-decoy, testing, normalising and learning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill.operators import statistics as S
from ionquill.plans.registry import query, table

SCORED = "WITH s AS (SELECT d.doc_id AS doc_id, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),"
QVALUES = (
    SCORED + " c AS (SELECT n_chars, sum(quality) AS t, sum(1 - quality) AS d FROM s GROUP BY 1),"
    " u AS (SELECT n_chars, sum(t) OVER w AS ct, sum(d) OVER w AS cd FROM c WINDOW w AS (ORDER BY n_chars DESC)),"
    " q AS (SELECT n_chars, min(CASE WHEN ct > 0 THEN least(1.0::DOUBLE, cd / ct) ELSE 1.0::DOUBLE END) OVER (ORDER BY n_chars) AS q FROM u)"
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(QVALUES + " SELECT doc_id, quality, round(q, 6) AS q_value FROM s JOIN q ON s.n_chars = q.n_chars")
def q_fdr_qvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target-decoy q-values, quality as the label and length as the score."""
    out = S.q_values(scored(spark, sf_dir), "n_chars", F.col("quality") == 1, "q_value")
    return out.select("doc_id", "quality", F.round("q_value", 6).alias("q_value"))


@query(QVALUES + " SELECT c::DOUBLE / 100 AS cut, count(*) FILTER (q < c::DOUBLE / 100) AS n, count(*) FILTER (q < c::DOUBLE / 100 AND quality = 1) AS n_targets FROM s JOIN q ON s.n_chars = q.n_chars, range(1, 31) t(c) GROUP BY c")
def q_fdr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.q_values(scored(spark, sf_dir), "n_chars", F.col("quality") == 1, "q_value")
    return S.fdr_curve(out, "q_value", [c / 100 for c in range(1, 31)], n_targets=F.col("quality") == 1)


@query("SELECT event_id, event_type, round(l - m + a, 6) AS normalised FROM (SELECT event_id, event_type, log2(nullif(value, 0)) AS l FROM events) JOIN (SELECT event_type, median(log2(nullif(value, 0))) AS m FROM events GROUP BY 1) USING (event_type), (SELECT median(log2(nullif(value, 0))) AS a FROM events)")
def q_median_equalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.log2("value").alias("l"))
    return S.medians_equalised(e, "event_type", "l", "normalised").select("event_id", "event_type", F.round("normalised", 6).alias("normalised"))


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def q_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.z_scores(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", F.round("z", 6).alias("z"))


@query(
    "WITH g AS (SELECT l_suppkey, l_returnflag = 'R' AS f, log2(l_extendedprice) AS x FROM lineitem WHERE l_returnflag IN ('R', 'A')),"
    " s AS (SELECT l_suppkey, count(x) FILTER (f) AS n1, count(x) FILTER (NOT f) AS n0, avg(x) FILTER (f) AS m1, avg(x) FILTER (NOT f) AS m0, var_samp(x) FILTER (f) AS v1, var_samp(x) FILTER (NOT f) AS v0 FROM g GROUP BY 1)"
    " SELECT l_suppkey, n1, n0, round(m1 - m0, 6) AS fold_change, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 5) AS t FROM s"
)
def q_fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('R', 'A')").select("l_suppkey", "l_returnflag", F.log2("l_extendedprice").alias("x"))
    out = S.two_sample_t(l, ["l_suppkey"], "x", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return out.select("l_suppkey", "n1", "n0", F.round("foldChange", 6).alias("fold_change"), F.round("t", 5).alias("t"))


@query()
def q_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the t-test, adjusted, and the class of each key; p needs the incomplete beta function, which SQL lacks."""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('R', 'A')").select("l_suppkey", "l_returnflag", F.log2("l_extendedprice").alias("x"))
    out = S.bh_adjusted(S.two_sample_t(l, ["l_suppkey"], "x", F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), "pValue")
    return out.withColumn("regulation", S.regulation(F.col("foldChange"), F.col("pValue")))


@query(
    "WITH p AS (SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) + 1 FROM orders) AS p FROM orders), r AS (SELECT o_orderkey, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) AS k, count(*) OVER () AS n FROM p)"
    " SELECT o_orderkey, round(least(1.0, min(p * n / k) OVER (ORDER BY p DESC)), 6) AS adjusted FROM r"
)
def q_bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    p = o.withColumn("p", F.col("o_totalprice") / (o.agg(F.max("o_totalprice") + 1).scalar()))
    return S.bh_adjusted(p, "p", "adjusted").select("o_orderkey", F.round("adjusted", 6).alias("adjusted"))


@query(
    "WITH c AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT a.event_type AS first, b.event_type AS second, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2"
)
def q_pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return S.pairwise_correlation(c, "user_id", "event_type", "v").withColumn("r", F.round("r", 6))


@query(
    "WITH e AS (SELECT DISTINCT user_id, epoch(ts) / 3600.0 AS x, value AS y FROM events), s AS (SELECT a.user_id AS user_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM e a JOIN e b ON a.user_id = b.user_id AND b.x > a.x GROUP BY 1)"
    " SELECT e.user_id AS user_id, round(any_value(slope), 5) AS slope, round(median(y - slope * x), 2) AS intercept FROM e JOIN s ON e.user_id = s.user_id GROUP BY 1"
)
def q_theilsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median-of-slopes line of each user's values over time, by all pairs of points."""
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0).alias("x"), F.col("value").alias("y")).distinct()
    out = S.median_slopes(e, ["user_id"], "x", "y")
    return out.select("user_id", F.round("slope", 5).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(
    "WITH c AS (SELECT l_shipmode_pos AS position, symbol, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM (SELECT i - 1 AS l_shipmode_pos, substring(p_name, i, 1) AS symbol, p_size > 25 AS f FROM part, range(1, (SELECT max(length(p_name)) + 1 FROM part)) t(i) WHERE i <= length(p_name)) GROUP BY 1, 2),"
    " s AS (SELECT position, symbol, a, b, a / sum(a) OVER (PARTITION BY position) AS p, b / sum(b) OVER (PARTITION BY position) AS q FROM c),"
    " e AS (SELECT position, a, b, (CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2 AS x FROM s)"
    " SELECT position::INTEGER AS position, CASE WHEN least(sum(a), sum(b)) = 0 THEN 'inf'::DOUBLE ELSE round(sum(x), 6) END AS divergence FROM e GROUP BY 1"
)
def q_js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the letters at each place between two kinds of parts, as a logo compares peptides."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("f"), F.posexplode(F.filter(F.split("p_name", ""), lambda x: x != "")).alias("position", "symbol"))
    out = S.divergence(p, ["position"], "symbol", F.col("f"))
    return out.select("position", F.round("divergence", 6).alias("divergence")).distinct()


@query("SELECT (i - 1)::INTEGER AS position, substring(p_name, i, 1) AS symbol, count(*) AS n FROM part, range(1, (SELECT max(length(p_name)) + 1 FROM part)) t(i) WHERE i <= length(p_name) GROUP BY 1, 2")
def q_symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.symbol_counts(table(spark, sf_dir, "part").select("p_name"), "p_name")


@query(
    "WITH l AS (SELECT (i - 1)::INTEGER AS position, substring(p_name, i, 1) AS symbol, p_size > 25 AS f FROM part, range(1, (SELECT max(length(p_name)) + 1 FROM part)) t(i) WHERE i <= length(p_name)),"
    " n AS (SELECT position, symbol, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS c FROM l GROUP BY 1, 2),"
    " w AS (SELECT position, symbol, a, sum(a) OVER p AS na, a + c AS col, sum(a) OVER p + sum(c) OVER p AS n FROM n WINDOW p AS (PARTITION BY position)),"
    " k AS (SELECT position, symbol, a, k, lgamma(na + 1) - lgamma(k + 1) - lgamma(na - k + 1) + lgamma(n - na + 1) - lgamma(col - k + 1) - lgamma(n - na - col + k + 1) AS x, lgamma(n + 1) - lgamma(col + 1) - lgamma(n - col + 1) AS whole"
    " FROM (SELECT *, unnest(range(greatest(0, na + col - n)::BIGINT, least(na, col)::BIGINT + 1)) AS k FROM (SELECT position, symbol, a, na::DOUBLE AS na, col::DOUBLE AS col, n::DOUBLE AS n FROM w))),"
    " o AS (SELECT position, symbol, x - whole AS own FROM k WHERE k = a), f AS (SELECT position, symbol, least(1.0, sum(exp(x - whole)) FILTER (x - whole <= own + 1e-7)) AS p FROM k JOIN o USING (position, symbol) GROUP BY 1, 2),"
    " r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) AS rk, count(*) OVER () AS m FROM f)"
    " SELECT position, symbol, round(p, 6) AS p, round(least(1.0, min(p * m / rk) OVER (ORDER BY p DESC)), 6) AS adjusted FROM r"
)
def q_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher's exact test of each letter at each place, adjusted."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("f"), F.posexplode(F.filter(F.split("p_name", ""), lambda x: x != "")).alias("position", "symbol"))
    c = p.groupBy("position", "symbol").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("c"))
    sums = c.groupBy("position").agg(F.sum("a").alias("na"), F.sum("c").alias("nc"))
    tested = c.join(sums, "position").select("position", "symbol", S.fisher_exact("a", F.col("na") - F.col("a"), "c", F.col("nc") - F.col("c")).alias("p"))
    return S.bh_adjusted(tested, "p", "adjusted").select("position", "symbol", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@query(
    "WITH e AS (SELECT l_partkey::VARCHAR AS protein, max(l_extendedprice) FILTER (l_returnflag <> 'R') AS t, max(l_extendedprice) FILTER (l_returnflag = 'R') AS d FROM lineitem GROUP BY 1)"
    " SELECT protein, t IS NOT NULL AND (d IS NULL OR t >= d) AS is_target, greatest(t, d) AS score FROM e"
)
def q_picked_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice")
    target = F.col("l_returnflag") != "R"
    name = F.array(F.concat(F.when(target, "").otherwise("rev_"), F.col("l_partkey").cast("string")))
    return S.picked_proteins(l, name, "l_extendedprice", target)


@query(
    "WITH f AS (SELECT user_id, event_type, max(value) AS area, min(value) AS background FROM events GROUP BY 1, 2), r AS (SELECT user_id, event_type, greatest(area - background, 0) AS raw, area / (area + background) AS ratio FROM f)"
    " SELECT user_id, event_type, CASE WHEN ratio > 0.8 THEN round(log2(nullif(raw, 0)), 6) END AS clean FROM r"
)
def q_quant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area less background, kept where it is most of the signal."""
    from ionquill.operators.quantification import quant_value, valid_log2

    f = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("area"), F.min("value").alias("background"))
    raw, ratio = quant_value(F.col("area"), F.col("background"))
    return f.select("user_id", "event_type", F.round(valid_log2(raw, ratio, F.lit(1.0)), 6).alias("clean"))


@query("SELECT o_custkey, avg(CASE WHEN o_totalprice > 250000 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS correct, count(*) FILTER (o_totalprice > 250000) AS predicted FROM orders GROUP BY 1")
def q_precision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = F.col("o_totalprice") > 250000
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.avg((above & (F.col("o_orderstatus") == "F")).cast("int")).alias("correct"), F.count_if(above).alias("predicted"))


@query()
def q_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionquill.operators.learning import clusters

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return clusters(e, "v", 7, seed=42).select("vec_id", "cluster")


@query()
def q_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionquill.operators.learning import principal_components

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return principal_components(e, "v", 2).select("vec_id", "pc1", "pc2")


@query()
def q_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-supervised target-decoy rescoring: one label's vectors as targets."""
    from ionquill.operators.rescoring import rescored

    names = [f"f{k}" for k in range(64)]
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("Label"), *[F.get("embedding", k).cast("double").alias(f) for k, f in enumerate(names)])
    return rescored(e, names, ["vec_id"]).select("vec_id", "Label", "score", "qValue", "postErrProb")
