import random

import numpy as np
import pytest

import corpus_pipeline
from ionquill.llm import shingles, simhash


def plain_set(text):
    tokens = (text or "").lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_kept(rows):
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                label[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((k is None, k or 0))
    return sorted(min(g) for g in groups.values())


def texts(seed, n):
    """Texts with none to many words changed, some of common phrases alone."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    phrases = [" ".join(rnd.choice(words) for _ in range(9)) for _ in range(6)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([3, 8, 30, 90, 200]))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        text = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        out.append(" ".join(text if rnd.random() < 0.8 else [*rnd.sample(phrases, 4), *text[:8]]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = [(k, t) for k, t in enumerate(texts(seed, 240))] + [(900, None), (901, ""), (902, " \n")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, lang string").repartition(5)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((False, r["doc_id"]) for r in got.collect()) == plain_kept(rows)


def test_stage_finds_copies_that_differ_in_many_bits(spark):
    rnd, pairs = random.Random(3), []
    while len(pairs) < 8:
        a = [f"v{rnd.randrange(900)}" for _ in range(120)]
        b = [*a[:60], "other", *a[61:]] if len(pairs) % 2 else [*a[9:], *[f"u{k}" for k in range(3)]]
        x, y = " ".join(a), " ".join(b)
        if alike(plain_set(x), plain_set(y)) and (simhash.text_fingerprint(x) ^ simhash.text_fingerprint(y)).bit_count() > 3:
            pairs.append((x, y))
    docs = spark.createDataFrame([(2 * k + i, t) for k, pair in enumerate(pairs) for i, t in enumerate(pair)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [2 * k for k in range(8)]


def test_each_path_brings_its_own_links(spark, monkeypatch):
    rnd, pairs = random.Random(12), {"near": [], "far": []}
    while min(map(len, pairs.values())) < 4:
        a = [f"t{rnd.randrange(900)}" for _ in range(rnd.choice([120, 400]))]
        b = list(a)
        b[60] = f"t{rnd.randrange(900)}"
        x, y = " ".join(a), " ".join(b)
        bits = (simhash.text_fingerprint(x) ^ simhash.text_fingerprint(y)).bit_count()
        own = pairs["far" if bits > 3 else "near"]
        if x != y and bits and len(own) < 4:
            own.append((x, y))
    rows = [(8 * far + 2 * k + i, t) for far, kind in enumerate(("near", "far")) for k, pair in enumerate(pairs[kind]) for i, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = lambda: sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept() == [0, 2, 4, 6, 8, 10, 12, 14]
    with monkeypatch.context() as m:  # without the index the pairs within three bits are lost, those alone
        m.setattr(simhash, "near_links", lambda fps, limit, hot: fps.select(fps.fp.alias("u"), fps.fp.alias("v")).where("false"))
        assert kept() == [*range(8), 8, 10, 12, 14]
    with monkeypatch.context() as m:  # without the rare runs the others
        m.setattr(simhash.shingles, "rare_links", lambda sets, limit: sets.select(sets.key.alias("u"), sets.key.alias("v")).where("false"))
        assert kept() == [0, 2, 4, 6, *range(8, 16)]


def test_clusters_follow_chains():
    sets = [np.arange(k, k + 30) for k in (0, 100, 3, 6, 200, 9)]
    assert shingles.clusters(np.array([len(s) for s in sets]), np.concatenate(sets)).tolist() == [0, 1, 0, 0, 4, 0]


def test_rows_compete_within_their_group_alone(spark):
    rnd = random.Random(5)
    one, two, three = (" ".join(f"z{rnd.randrange(900)}" for _ in range(40)) for _ in range(3))
    rows = [(None, one), (None, one), (7, two), (7, three), (9, two), (None, three)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([(None, one), (7, two), (7, three)], "doc_id long, text string").collect())


def test_other_columns_and_repeats(spark):
    rnd = random.Random(6)
    one, two = (" ".join(f"y{rnd.randrange(900)}" for _ in range(40)) for _ in range(2))
    rows = [(1, one, 1, 2), (5, one, 3, 4), (5, two, 5, 6), (5, two, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file_0 int, at long")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [rows[0], rows[2]]
    assert simhash.keep_one(docs.where("false")).collect() == []
    with pytest.raises(ValueError, match="_metadata"):
        simhash.keep_one(docs.withColumnRenamed("at", "_metadata"))


def test_very_long_and_read_from_files(spark, tmp_path):
    rnd = random.Random(7)
    long = [f"x{rnd.randrange(5000)}" for _ in range(60_000)]
    rows = [(3, " ".join(long)), (2, " ".join([*long[:40_000], "new", *long[40_001:]])), (4, " ".join(long[30_000:])), (None, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    got = simhash.keep_one(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 4, 8]
