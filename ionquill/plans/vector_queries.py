"""Queries of the array and peptide expressions, on embeddings, part names and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill.constants import PROTON, RESIDUE_MASS
from ionquill.functions import arrays as A
from ionquill.functions import peptides as P
from ionquill.plans.registry import query, table

PAIRED = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pos AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY label, i),
centre AS (SELECT label, list(m ORDER BY i) AS c FROM pos GROUP BY label),
paired AS (SELECT e.vec_id, e.label, e.v, c.c FROM e JOIN centre c USING (label))
"""


def with_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector ``v`` beside the mean vector ``c`` of its label; labels are few, so the centroids are broadcast by size."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.transform("c", lambda s: s["m"]).alias("c"))
    return e.join(centre, "label")


@query(PAIRED + "SELECT vec_id, round(1 - 2 * acos(greatest(-1, least(1, list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c)))))) / pi(), 6) AS angle FROM paired")
def q_spectral_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_centroid(spark, sf_dir).select("vec_id", F.round(A.spectral_angle(F.col("v"), F.col("c")), 6).alias("angle"))


@query(PAIRED + ", flat AS (SELECT vec_id, unnest(v) AS a, unnest(c) AS b FROM paired) SELECT vec_id, round(corr(a, b), 6) AS r FROM flat GROUP BY vec_id")
def q_array_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_centroid(spark, sf_dir).select("vec_id", F.round(A.pearson(F.col("v"), F.col("c")), 6).alias("r"))


@query(
    PAIRED + ", flat AS (SELECT vec_id, unnest(v) AS a, unnest(c) AS b FROM paired),"
    " ranked AS (SELECT vec_id, rank() OVER (PARTITION BY vec_id ORDER BY a) + (count(*) OVER (PARTITION BY vec_id, a) - 1) / 2 AS ra,"
    " rank() OVER (PARTITION BY vec_id ORDER BY b) + (count(*) OVER (PARTITION BY vec_id, b) - 1) / 2 AS rb FROM flat)"
    " SELECT vec_id, round(corr(ra, rb), 6) AS rho FROM ranked GROUP BY vec_id"
)
def q_array_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_centroid(spark, sf_dir).select("vec_id", F.round(A.spearman(F.col("v"), F.col("c")), 6).alias("rho"))


@query(PAIRED + ", flat AS (SELECT vec_id, unnest(v) AS a, unnest(c) AS b FROM paired) SELECT vec_id, round(median(abs(a - b)), 6) AS mae FROM flat GROUP BY vec_id")
def q_array_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_centroid(spark, sf_dir).select("vec_id", F.round(A.median_absolute_error(F.col("v"), F.col("c")), 6).alias("mae"))


@query(
    "WITH flat AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance,"
    " round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3, round(sqrt(sum(x * x)), 5) AS length FROM flat GROUP BY vec_id"
)
def q_array_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select(
        "vec_id", F.round(A.mean(v), 6).alias("mean"), F.round(A.sample_variance(v), 6).alias("variance"),
        F.round(A.quantile(v, 0.25), 6).alias("q1"), F.round(A.quantile(v, 0.75), 6).alias("q3"), F.round(A.norm(v), 5).alias("length"),
    )


@query(
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
    " SELECT vec_id, len(list_filter(v, lambda x: abs(x) / sqrt(list_dot_product(v, v)) >= 0.1))::INTEGER AS n_major, len(list_filter(v, lambda x: abs(x) / sqrt(list_dot_product(v, v)) < 0.1))::INTEGER AS n_minor,"
    " round(len(v) / (list_max(v) - list_min(v)), 6) AS density FROM e"
)
def q_major_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scaled = e.withColumn("u", A.unit(v))
    return scaled.select(
        "vec_id", F.size(F.filter("u", lambda x: F.abs(x) >= 0.1)).alias("n_major"), F.size(F.filter("u", lambda x: F.abs(x) < 0.1)).alias("n_minor"),
        F.round(F.size(v) / (F.array_max(v) - F.array_min(v)), 6).alias("density"),
    )


@query(
    "SELECT vec_id, i::INTEGER AS target, round(x.d, 6) AS distance, x.i0::INTEGER AS nearest FROM (SELECT e.vec_id, t.i, (SELECT min({'d': abs(u.v::DOUBLE - t.i / 10.0), 'i0': u.k - 1})"
    " FROM (SELECT unnest(e.embedding) AS v, generate_subscripts(e.embedding, 1) AS k) u) AS x FROM embeddings e, range(-2, 3) t(i))"
)
def q_nearest_in_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest element of an array to each of a few targets: how fragments meet peaks."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    at = e.select("vec_id", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda t: F.struct(t.alias("target"), A.nearest(F.col("v"), t / 10).alias("x")))).alias("s"))
    return at.select("vec_id", "s.target", F.round("s.x.distance", 6).alias("distance"), F.col("s.x.index").alias("nearest"))


PEPTIDES = "WITH p AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM part)"


def part_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with the letters that stand for no residue left out, as stand-ins for peptides."""
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("s"))


def _mass_case(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{r}' THEN {m}::DOUBLE" for r, m in RESIDUE_MASS.items()) + " END"


@query(
    PEPTIDES + ", r AS (SELECT p_partkey, length(s) AS n, i, substring(s, i, 1) AS a FROM p, range(1, 60) t(i) WHERE i <= length(s)),"
    f" w AS (SELECT p_partkey, n, i, {_mass_case('a')} AS m FROM r),"
    " b AS (SELECT p_partkey, n, i, sum(m) OVER (PARTITION BY p_partkey ORDER BY i) AS prefix, sum(m) OVER (PARTITION BY p_partkey ORDER BY i DESC) AS suffix FROM w)"
    f" SELECT p_partkey, i::INTEGER AS position, round(prefix + {PROTON}::DOUBLE, 4) AS b_mz FROM b WHERE i < n"
)
def q_fragment_mz(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    ions = F.transform(P.ion_masses(F.col("s"), none, {}, "b"), lambda m: P.mz(m, 1))
    return part_peptides(spark, sf_dir).select("p_partkey", F.posexplode(ions).alias("k", "mz")).select("p_partkey", (F.col("k") + 1).alias("position"), F.round("mz", 4).alias("b_mz"))


@query(
    PEPTIDES + " SELECT p_partkey, s AS peptide, len(list_distinct(string_split(s, ''))) / length(s) AS frac_unique, (length(s) - length(replace(s, 'C', ''))) / length(s) AS frac_c,"
    " round((length(s) - length(regexp_replace(s, '[KR]', '', 'g'))) / (length(s) - 1), 6) AS frac_kr,"
    " (SELECT count(*) FROM range(1, 60) t(i) WHERE i < length(s) AND substring(s, i, 1) = substring(s, i + 1, 1))::INTEGER AS n_repeated,"
    " round(abs(length(s) - (SELECT avg(length(s)) FROM p)), 6) AS len_diff FROM p"
)
def q_residue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_peptides(spark, sf_dir)
    s, mean = F.col("s"), p.agg(F.avg(F.length("s"))).scalar()
    return p.select(
        "p_partkey", s.alias("peptide"), P.fraction_unique(s).alias("frac_unique"), P.fraction_cysteine(s).alias("frac_c"), F.round(P.fraction_basic(s), 6).alias("frac_kr"),
        P.n_repeated(s).alias("n_repeated"), F.round(F.abs(F.length(s) - mean), 6).alias("len_diff"),
    )


@query(PEPTIDES + " SELECT p_partkey, replace(s, 'I', 'L') AS folded, reverse(s) AS decoy, replace(s, 'M', 'M(ox)') AS modified, length(s)::INTEGER AS n FROM p WHERE length(s) BETWEEN 5 AND 30 AND NOT contains(s, 'U')")
def q_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    code = F.concat(F.lit("0."), F.regexp_replace(F.regexp_replace(s, "[^M]", "0"), "M", "2"), F.lit(".0"))
    fit = part_peptides(spark, sf_dir).where(P.predictable(s, F.lit(2)))
    return fit.select("p_partkey", P.fold_il(s).alias("folded"), F.reverse(s).alias("decoy"), P.predictor_sequence(s, code).alias("modified"), F.length(s).alias("n"))


@query(
    PEPTIDES + f", r AS (SELECT p_partkey, s, unnest(string_split(s, '')) AS a FROM p) SELECT p_partkey, round(sum({_mass_case('a')}) + 18.0105647::DOUBLE + 15.994915::DOUBLE * (length(s) - length(replace(s, 'M', ''))), 4) AS mass,"
    " replace(s, 'M', 'M[+16.0]') AS tagged FROM r GROUP BY p_partkey, s"
)
def q_modified_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass with every methionine oxidised, and the sequence with mass tags; the code is read back from the tags."""
    s, masses = F.col("s"), {2: 15.994915}
    tagged = F.regexp_replace(s, "M", "M[+16.0]")
    rows = part_peptides(spark, sf_dir).withColumn("code", P.code_from_tags(tagged, masses))
    return rows.select("p_partkey", F.round(P.peptide_mass(s, F.col("code"), masses), 4).alias("mass"), P.mass_tagged(s, F.col("code"), masses).alias("tagged"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem")
def q_prefix_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return table(spark, sf_dir, "lineitem").select(*keys, F.round(F.sum("l_quantity").over(w), 2).alias("running"))


@query(
    "WITH s AS (SELECT l_partkey, sum(l_extendedprice) AS whole FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l.l_partkey AS l_partkey, round(l_quantity * l_extendedprice / whole, 6) AS apportioned FROM lineitem l JOIN s ON l.l_partkey = s.l_partkey"
)
def q_shared_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantity shared by all rows of a key in proportion to their weight, as ions share a peak."""
    from ionquill.operators.relational import group_transform

    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    own = group_transform(l, ["l_partkey"], whole=F.sum("l_extendedprice"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") * F.col("l_extendedprice") / F.col("whole"), 6).alias("apportioned"))


