"""Queries of the joins, group filters, windows, set operations and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionquill.operators import relational as R
from ionquill.plans.registry import query, table

LINE_ORDER = "l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) = 1")
def q_top1_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return R.top_one(l, ["l_orderkey"], F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")).drop("l_suppkey")


@query("WITH d AS (SELECT DISTINCT l_partkey, l_extendedprice FROM lineitem) SELECT l_partkey, l_extendedprice, round(l_extendedprice - coalesce(nth_value(l_extendedprice, 2) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 2) AS delta_score FROM d")
def q_rank2_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice").distinct()
    return R.second_best_gap(d, ["l_partkey"], "l_extendedprice", "delta_score").withColumn("delta_score", F.round("delta_score", 2))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (count(*) OVER (PARTITION BY l_orderkey) > 1)::INTEGER AS from_chimera FROM lineitem")
def q_chimera_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = (F.count("l_partkey").over(Window.partitionBy("l_orderkey")) > 1).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("from_chimera"))


@query(
    "WITH w AS (SELECT l_orderkey, l_returnflag = 'R' AS flag, l_extendedprice * CASE WHEN l_linestatus = 'O' THEN 0.7 ELSE 1.0 END::DOUBLE AS w FROM lineitem),"
    " best AS (SELECT l_orderkey, max_by(flag, {'w': w, 'f': flag::INTEGER}) AS bad FROM w GROUP BY 1)"
    " SELECT l.l_orderkey AS l_orderkey, count(*) AS n FROM lineitem l JOIN best b ON l.l_orderkey = b.l_orderkey WHERE NOT bad GROUP BY 1"
)
def q_weighted_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose best weighted row is flagged go: scores outside the first stratum count 0.7 times."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    weight = F.col("l_extendedprice") * F.when(F.col("l_linestatus") == "O", 0.7).otherwise(1.0)
    kept = R.without_flagged_best(l, ["l_orderkey"], weight, F.col("l_returnflag") == "R")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(c_custkey, o_custkey) AS custkey, c_mktsegment, n, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS side FROM customer c FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def q_full_outer_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n"))
    return R.outer_with_indicator(c, o, ["custkey"])


@query("SELECT event_id, user_id, event_type FROM events QUALIFY NOT bool_or(event_type = 'error' AND value > 250) OVER (PARTITION BY user_id)")
def q_control_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return R.without_controls(e, ["user_id"], (F.col("event_type") == "error") & (F.col("value") > 250)).drop("value")


@query("SELECT p_partkey, s_suppkey, round(abs(p_retailprice - s_acctbal), 4) AS distance FROM part, supplier WHERE abs(p_retailprice - s_acctbal) <= 25.0")
def q_tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    pairs = R.tolerance_join(p, s, "p_retailprice", "s_acctbal", 25.0)
    return pairs.select("p_partkey", "s_suppkey", F.round(F.abs(F.col("p_retailprice") - F.col("s_acctbal")), 4).alias("distance"))


@query("SELECT p_partkey, s_acctbal AS nearest FROM part, (SELECT DISTINCT s_acctbal FROM supplier) WHERE abs(p_retailprice - s_acctbal) <= 40.0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_retailprice - s_acctbal), s_acctbal) = 1")
def q_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), table(spark, sf_dir, "supplier").select("s_acctbal").distinct()
    return R.nearest_join(p, s, "p_retailprice", "s_acctbal", 40.0, ["p_partkey"]).select("p_partkey", F.col("s_acctbal").alias("nearest"))


@query("SELECT item_id, doc_id, instr(d.text, b.text)::INTEGER AS position FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q_substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that whole documents hold: the k-mer join that maps peptides to proteins."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return R.substring_join(b, d, "text", "body", 20, "item_id", "doc_id")


@query("SELECT * FROM (SELECT user_id, event_type, value FROM events) PIVOT (round(avg(value), 6) FOR event_type IN ('click' AS click, 'view' AS \"view\", 'error' AS error) GROUP BY user_id)")
def q_pivot_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return e.groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.round(F.avg("value"), 6))


@query("SELECT user_id, " + ", ".join(f"max((event_type = '{t}' AND value > 200)::INTEGER) AS {t}_identified" for t in ("click", "purchase", "signup")) + " FROM events GROUP BY 1")
def q_presence_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    found = [F.max(((F.col("event_type") == t) & (F.col("value") > 200)).cast("int")).alias(f"{t}_identified") for t in ("click", "purchase", "signup")]
    return e.groupBy("user_id").agg(*found)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT x FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = floor(0.9 * (n - 1) + 0.5)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 600")
def q_quantile_cut_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 600 above the nearest-rank 0.9 quantile: how calibration picks its rows."""
    from ionquill.operators.running import exact_quantile_nearest

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cut = exact_quantile_nearest(o, "o_totalprice", 0.9)
    return o.where(F.col("o_totalprice") > cut).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(600)


@query("SELECT p_partkey, (min(CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 3 END))::INTEGER AS stratum FROM (SELECT p_partkey, unnest([p_type, p_brand]) AS p_type FROM part) GROUP BY 1")
def q_accession_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionquill.operators.proteome import accession_group

    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(";", "p_type", "p_brand").alias("proteins"))
    return p.select("p_partkey", accession_group(F.col("proteins"), ["PROMO", "ECONOMY", "STANDARD"], ";", unmatched=3).alias("stratum"))


@query("WITH g AS (SELECT user_id, ce, avg(value * cos((ce - 20 - user_id % 21) / 10.0)) AS fit FROM events, range(20, 41) t(ce) GROUP BY 1, 2) SELECT user_id, ce::INTEGER AS collision_energy FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(fit, 9) DESC, ce) = 1")
def q_grid_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of 21 settings for each source by mean score; equal means go to the lower setting."""
    from ionquill.operators.calibration import best_setting

    e = table(spark, sf_dir, "events").select("user_id", "value")
    grid = e.withColumn("ce", F.explode(F.sequence(F.lit(20), F.lit(40))))
    fit = F.col("value") * F.cos((F.col("ce") - 20 - F.col("user_id") % 21) / 10.0)
    return best_setting(grid.withColumn("fit", fit), ["user_id"], "ce", "fit").select("user_id", F.col("ce").alias("collision_energy"))


@query("SELECT n_name, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, list_sort(list(DISTINCT c_mktsegment)) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def q_collect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of each key, as the list and as a count."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("segments"), F.sort_array(F.collect_set("c_mktsegment")).alias("names"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, min(l_discount) OVER (PARTITION BY l_suppkey) AS best, (SELECT count(DISTINCT l_partkey) FROM lineitem m WHERE m.l_suppkey = l.l_suppkey) AS n_parts, l_discount = min(l_discount) OVER (PARTITION BY l_suppkey) AS is_best FROM lineitem l")
def q_group_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount")
    own = R.group_transform(l, ["l_suppkey"], best=F.min("l_discount"), n_parts=F.count_distinct("l_partkey"))
    return own.select("l_orderkey", "l_linenumber", "l_suppkey", "best", "n_parts", (F.col("l_discount") == F.col("best")).alias("is_best"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def q_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return a.intersect(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("SELECT o_orderpriority, o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 500)::INTEGER AS batch FROM orders")
def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered batches of 500 a group: the files that a binding predictor reads."""
    return R.batched(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], 500, F.asc("o_orderkey"))


@query("WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice AS best FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(best, -100000.0) AS rival FROM lineitem JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN b ON o.o_custkey = b.o_custkey AND b.o_orderkey <> l_orderkey WHERE l_extendedprice > coalesce(best, -100000.0)")
def q_self_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that beat the best competitor of their group; without one they stay."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    best = R.top_one(o, ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("rival_key"), F.col("o_totalprice").alias("best"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rival = F.coalesce(F.when(F.col("rival_key") != F.col("l_orderkey"), F.col("best")), F.lit(-100000.0))
    return l.join(best, "o_custkey", "left").withColumn("rival", rival).where(F.col("l_extendedprice") > F.col("rival")).select("l_orderkey", "l_linenumber", "l_extendedprice", "rival")


@query("SELECT n_name, r_name, coalesce(n, 0) AS n_suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) ON s_nationkey = n_nationkey")
def q_left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_suppliers"))


@query("SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1) * (SELECT max(user_id) FROM events) + user_id AS scannr FROM events")
def q_unique_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number for each (file, scan): the file's index times the largest scan, plus the scan."""
    from ionquill.operators.features import unique_scan

    return unique_scan(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_type", "user_id").select("event_id", "scannr")


@query("SELECT event_id, CASE WHEN value > 30 THEN value ELSE m END AS imputed FROM (SELECT event_id, event_type, CASE WHEN value > 30 THEN value ELSE -1 END AS value FROM events) JOIN (SELECT event_type, median(value) AS m FROM events WHERE value > 30 GROUP BY 1) USING (event_type)")
def q_sentinel_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of -1 become their file's median of the others."""
    from ionquill.operators.features import imputed

    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") > 30, F.col("value")).otherwise(-1.0).alias("value"))
    return imputed(e, "event_type", ["value"]).select("event_id", F.col("value").alias("imputed"))


@query("WITH s AS (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS gap FROM events)) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k")
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("began"), F.count(F.lit(1)).alias("n")).drop("w")


@query("SELECT p_brand, p_type, sum(p_size)::BIGINT AS size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
def q_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.sum("p_size").alias("size"), F.count(F.lit(1)).alias("n"))


@query("SELECT l.p_partkey AS p_partkey, r.p_partkey AS other_p_partkey FROM part l JOIN part r ON round(l.p_retailprice / 7, 2) = round(r.p_retailprice / 7, 2) WHERE l.p_type = 'PROMO' AND r.p_type = 'SMALL'")
def q_isobaric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", (F.col("p_retailprice") / 7).alias("mw"))
    return R.isobaric_join(p.where("p_type = 'PROMO'").drop("p_type"), p.where("p_type = 'SMALL'").drop("p_type"), "mw").select("p_partkey", "other_p_partkey")


@query("SELECT p_partkey, substring(p_name, i, n) AS part FROM part, range(7, 10) a(n), range(1, 40) b(i) WHERE i + n - 1 <= length(p_name)")
def q_sub_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sub_sequences(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 7, 9).select("p_partkey", "part")
