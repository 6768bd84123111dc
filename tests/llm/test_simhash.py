import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ionquill.llm import simhash
from ionquill.llm.components import components


def plain_fingerprint(text):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        tokens = tokens.replace(c, " ")
    tokens = [t for t in tokens.split(" ") if t]
    if not tokens:
        return 0
    runs = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, limit=3):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                label[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def near_texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 60, 200]))] for _ in range(n // 5)]
    out = []
    for _ in range(n):
        text = list(rnd.choice(base))
        if rnd.random() < 0.7:
            text[rnd.randrange(len(text))] = rnd.choice(words)
        out.append(rnd.choice([" ", "\n", "\t "]).join(text))
    return out


def test_fingerprint_is_the_plain_one():
    for text in [None, "", " \n", "One", "one two", "One TWO three", "Größe ÀB c d", "a\x85b \xa0 c d e", *near_texts(1, 40)]:
        assert simhash.text_fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_pairs(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in centres]))
    group = rng.integers(0, 3, len(fps))
    index = simhash.GrayIndex(fps, group)
    i, j = index.pairs(np.arange(len(fps)), 3)
    got = {frozenset((int(index.fps[a]), int(index.fps[b]))) for a, b in zip(i, j)}
    want = {frozenset((int(fps[a]), int(fps[b]))) for a in range(len(fps)) for b in range(a) if group[a] == group[b] and int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert got == want and len(i) == len(want)


@pytest.mark.parametrize("hot", [4096, 8])
def test_groups_equal_brute_force(spark, hot):
    texts = [None, "", "", *near_texts(7, 150)]
    ids = [None if k == 20 else (5 if k == 6 else 1000 - k) for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), [0] * len(ids))), "doc_id long, text string, fp string, component_id int").repartition(5)
    got = simhash.near_groups(docs, hot=hot).collect()
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted(zip([i if i is not None else -1 for i in ids], [f"{f:016x}" for f in fps], plain_components(ids, fps)))
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.range(500, 501).select(F.lit(500), F.lit(499)))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 499: 499, 500: 499}
