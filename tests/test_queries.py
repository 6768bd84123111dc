"""Every registered query against its SQL on small tables made here."""

import datetime
import json
import math
import random

import duckdb
import pytest

from ionquill.plans import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    path = tmp_path_factory.mktemp("tables")
    day = lambda: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=rnd.randint(0, 2000))
    words = "small red green widget ring bolt mint coil magic kit".split()
    made = {
        "region": ("r_regionkey int, r_name string", [(k, f"R{k}") for k in range(3)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(k, f"N{k}", k % 3) for k in range(6)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(k, f"C{k}", k % 5, rnd.randint(0, 900000) / 100, rnd.choice("ABC")) for k in range(60)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(k, f"S{k}", k % 6, rnd.randint(80000, 120000) / 100) for k in range(20)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(k, f"{rnd.choice(words)} {rnd.choice(words)}", f"Brand#{k % 5}", rnd.choice(["PROMO", "SMALL", "ECONOMY"]), rnd.randint(1, 50), 900 + k / 10) for k in range(80)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", [(k, rnd.randint(0, 59), rnd.choice("FOP"), rnd.randint(100000, 50000000) / 100, day(), rnd.choice(["1-URGENT", "5-LOW"])) for k in range(300)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
            [(rnd.randint(0, 299), rnd.randint(0, 79), rnd.randint(0, 19), k, float(rnd.randint(1, 50)), rnd.randint(90000, 9000000) / 100, rnd.randint(0, 10) / 100, 0.0, rnd.choice("RAN"), rnd.choice("OF"), day()) for k in range(900)],
        ),
        "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=977 * k + rnd.randint(0, 900)), rnd.randint(0, 14), rnd.choice(["view", "click", "error", "signup", "purchase"]), rnd.randint(1, 40000) / 100, json.dumps({"k": k})) for k in range(400)]),
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(k, t := " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 40))), "en", "s", len(t)) for k in range(50)]),
        "embeddings": ("vec_id long, embedding array<float>, label int", [(k, [rnd.gauss(0, 0.2) for _ in range(64)], k % 3) for k in range(60)]),
        "labels": ("doc_id long, quality int, toxic int", [(k, int(rnd.random() < 0.7), 0) for k in range(0, 50, 2)]),
    }
    documents = made["documents"][1]
    made["benchmark"] = ("item_id long, text string", [(k, documents[k * 3][1][:60]) for k in range(8)] + [(90, "nowhere to be found in any text at all")])
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"{name}.parquet"))
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return path


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


SLOW = {"q_rescore"}


@pytest.mark.parametrize("name", [q for q in catalog.queries() if q not in SLOW])
def test_query_matches_its_sql(spark, folder, name):
    got = catalog.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(columns).collect())
    if name not in catalog.oracle_sql():
        assert rows
        return
    rel = duckdb.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = sorted(range(len(columns)), key=rel.columns.__getitem__)
    assert rows == sorted(tuple(plain(r[k]) for k in order) for r in rel.fetchall())
