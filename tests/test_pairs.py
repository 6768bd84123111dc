"""Queries that count or average over pairs, without forming a pair for each two rows."""

import math
import random

import duckdb
import pytest

from ionquill.operators import relational as R
from ionquill.plans import catalog
from ionquill.sources.spectra import spread_retention_times


def most_joined(df):
    """Rows of ``df``, and the most rows that any join of its plan put out."""
    rows, found = df.collect(), [0]

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if "Join" in kind:
            found.append(plan.metrics().apply("numOutputRows").value())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, max(found)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pairs")
    parts = [(k, ("small red widget", "mint coil", "red small widget")[k % 3], k % 4 + 1, 900 + k % 7 / 10) for k in range(600)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(str(path / "part.parquet"))
    spark.createDataFrame([(50 * k + k % 4 + 1, k % 5) for k in range(600)], "o_orderkey long, o_custkey long").write.parquet(str(path / "orders.parquet"))
    return path


def same_as_sql(name, folder, rows):
    for t in ("part", "orders"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rel = duckdb.sql(catalog.oracle_sql()[name])
    assert sorted(tuple(r[c] for c in rel.columns) for r in rows) == sorted(rel.fetchall())


def test_times_of_repeated_values(spark, folder):
    rows, joined = most_joined(catalog.queries()["q_spread_times"](spark, str(folder)))
    same_as_sql("q_spread_times", folder, rows)
    # 600 spectra at 20 points, 600 peaks at 300 of them; pairs of rows would be more than 18,000
    assert joined < 2000


def test_times_equal_plain_means(spark):
    rnd = random.Random(4)
    peaks = [("ab"[rnd.randrange(2)], rnd.choice([0.0, 7.5, 61.0, 119.9, rnd.uniform(-90, 200)]), 500 + rnd.choice([0.0, 0.01, 0.4, rnd.random()]), rnd.choice([None, 0.0, 1.0, rnd.random()])) for _ in range(300)]
    spectra = [("abc"[rnd.randrange(3)], k // 2, 500 + rnd.choice([0.0, 0.4, rnd.random()]), rnd.choice([None, 1.0, 60.0, rnd.uniform(-90, 200)])) for k in range(200)]
    ms1 = spark.createDataFrame([(s, t, [m], [i]) for s, t, m, i in peaks], "source string, retentionTime double, mzs array<double>, intensities array<double>")
    ms2 = spark.createDataFrame([(*r, n) for n, r in enumerate(spectra)], "source string, scan long, precursor double, retentionTime double, n int")
    got = {r["n"]: r["retentionTime"] for r in spread_retention_times(ms2, ms1, 60.0, 0.2).collect()}
    assert len(got) == len(spectra)
    for n, (source, scan, _, own) in enumerate(spectra):
        met = [(t, i) for s, k, m2, t2 in spectra if (s, k) == (source, scan) and t2 is not None for s1, t, m, i in peaks if s1 == s and i is not None and abs(t - t2) < 60 and abs(m - m2) < 0.2]
        weight = sum(i for _, i in met)
        want = sum(t * i for t, i in met) / weight if weight else own
        assert got[n] == want or math.isclose(got[n], want, rel_tol=1e-9, abs_tol=1e-9)


def test_isobaric_counts_without_pairs(spark, folder):
    rows, joined = most_joined(catalog.queries()["q_isobaric_peptides"](spark, str(folder)))
    same_as_sql("q_isobaric_peptides", folder, rows)
    # 400 parts of one mass, 200 of another: 199,400 pairs of rows
    assert joined <= 600


def test_isobaric_counts_equal_the_join(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, 1.0, 1.004, 1.006, 2.0, 900.0 + k])) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, mw double")
    pairs = R.isobaric_join(df, df, "mw").where("k <> other_k").groupBy("k").count()
    assert sorted(R.isobaric_counts(df, "k", "mw").collect()) == sorted(pairs.collect())
    assert sorted(R.isobaric_counts(df, "k", "mw", 1, "n").collect()) == sorted(R.isobaric_join(df, df, "mw", 1).where("k <> other_k").groupBy("k").count().collect())
