"""The pipeline and the registered queries over small tables, held against plain versions."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ionquill.llm import pseudonyms, queries_docs, registry

WORDS = "the river walked under quiet stones and light fell on water while gulls cried over waves harbour sails".split()


def good(rnd, n=120):
    return " ".join(rnd.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    rows = []
    for k in range(160):
        text = good(rnd, rnd.choice([100, 150, 1500]))
        if k % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if k % 10 == 1:
            text += " write to the.72@mail3.example.com or 4111111111111111"
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
    rows += [(200 + k, rows[1][1], "en", "src0", rows[1][4]) for k in range(6)]
    base = good(random.Random(9), 3000).split()
    for k in range(5):
        rows.append((300 + k, t := " ".join([*base[:50], f"word{k}", *base[51:]]), "de", "src1", len(t)))
    rows += [(400, None, None, None, None), (401, "", "en", "src0", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(path / "documents.parquet"))
    labels = [(k, int(k % 4 != 0), 0) for k in range(0, 160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(0, 0.2, 8).astype("f4").tolist(), 0) for k in range(100)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    pages = [(k, f"http://a.example.{t}/{p}/{k}", f"<article><p>{good(rnd, 20)}</p></article>") for k, (t, p) in enumerate([("net", "de"), ("net", "en"), ("org", "fr"), ("com", "x")] * 6)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(str(path / "documents.parquet"))
    text = {r[0]: r[1] for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {k for k in range(160) if k % 4}
    assert {k for k in kept["quality"] if k < 160} == clean
    # the least id of every group of similar sets of five-word runs, of what the first stage kept
    runs = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for k, t in kept["quality"].items()}
    groups = {k: k for k in runs}

    def find(k):
        while groups[k] != k:
            k = groups[k]
        return k

    for a in runs:
        for b in runs:
            if a < b and 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b]):
                x, y = find(a), find(b)
                groups[max(x, y)] = min(x, y)
    assert set(kept["near_duplicates"]) == {k for k in runs if find(k) == k}
    assert {k for k in kept["near_duplicates"] if 200 <= k < 400} == {300}
    tool = pseudonyms.Pseudonyms(queries_docs.key(spark))
    want = {k: t if t is None else tool.replace(t)[0] for k, t in kept["near_duplicates"].items()}
    assert kept["personal_data"] == want
    assert all("mail3.example.com" not in t and "4111111111111111" not in t for t in kept["personal_data"].values() if t)
    assert all(kept["personal_data"][k] == text[k] for k in kept["personal_data"] if k % 10 != 1 and k < 160)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(path)).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
    for k, t in kept["personal_data"].items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces.pop(k), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    assert not pieces
    run = corpus_pipeline.run(spark, str(path)).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, run)) == sorted(map(key, packed))


@pytest.mark.parametrize("name", registry.QUERIES)
def test_queries_run_and_match_their_sql(spark, folder, name):
    path, _ = folder
    got = registry.queries()[name](spark, str(path))
    rows = sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=str)
    assert rows
    if name in registry.SQL:
        for t in ("documents", "embeddings", "pages", "labels"):
            duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        rel = duckdb.sql(registry.SQL[name])
        order = sorted(range(len(rel.columns)), key=rel.columns.__getitem__)
        assert sorted(rel.columns) == sorted(got.columns)
        assert rows == sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=str)
