import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from ionquill.llm import imatch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(data, seed=42):
    return signed(xxhash.xxh64_intdigest(data, seed % (1 << 64)))


def plain_terms(text):
    return {h(w.encode()) for w in re.split(r"[\W_]+", (text or "").lower()) if w}


def plain_signs(terms, band):
    held = terms & band
    out, shift = [], 0
    for count, power in imatch.SUBSETS:
        for k in range(count):
            own = sorted(t for t in held if t >> shift & ((1 << power) - 1) == k)
            x = 42
            for t in own:
                x = h(t.to_bytes(8, "little", signed=True), x)
            out.append(x if own else None)
        shift += power
    return out


def plain_likeness(a, b):
    held = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in held) / len(held) if held else 1.0


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h((r[1] or "").encode()), r[1] or ""))
    df = Counter(x for _, t in rows for x in plain_terms(t))
    least = max(imatch.LEAST_DOCS, math.ceil(imatch.LEAST_SHARE * len(rows)))
    most = max(least, int(imatch.MOST_SHARE * len(rows)))
    band = {x for x, n in df.items() if least <= n <= most}
    write = lambda s: ".".join("" if x is None else f"{x % 2**64:x}" for x in s)
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (plain_signs(plain_terms(t), band) for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), write(a), write(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    lexicon = [f"wörd{k}" for k in range(400)]
    return [" ".join(rnd.choice(lexicon) for _ in range(rnd.choice([1, 3, 10, 80]))) + rnd.choice(["", ".", "!\n x"]) for _ in range(n)]


@pytest.mark.parametrize("about", [256, 7])
def test_equals_brute_force(spark, about):
    rows = [(k * 3 + 5, t) for k, t in enumerate(texts(1, 60))]
    rows += [(900, None), (901, ""), (902, "🙂 A"), (902, "other words"), (903, rows[0][1]), (903, rows[0][1]), (None, "no id"), (10_000, "last é"), (2**63 - 1, "far"), (-(2**63), "first of all")]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, cell string, next int").repartition(5)
    got = sorted(map(tuple, imatch.edit_likeness(docs, about=about).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(7, "just some words")], "doc_id long, text string")
    assert list(map(tuple, imatch.edit_likeness(docs).collect())) == plain([(7, "just some words")])
    assert imatch.edit_likeness(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(7, "just some words")], "doc_id long, text string")
    plan = imatch.edit_likeness(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_equal_texts_have_equal_fingerprints(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts(2, 30) * 2)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs).collect()}
    assert all(got[k] == got[k + 30] for k in range(30))


def test_lexicon_by_exact_frequencies(spark):
    # 1000 documents: a word in every one, words in 10, in 5, in 2 and in 1 of them
    rows = [(k, f"all ten{k // 10} five{k // 5} two{k // 2} one{k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["term"] for r in imatch._lexicon(docs, "text", 0.003, 0.01, 2).collect()} == {h(f"{w}{k}".encode()) for w, n in (("ten", 100), ("five", 200)) for k in range(n)}
    assert {r["term"] for r in imatch._lexicon(docs, "text", 0.0, 0.004, 2).collect()} == {h(f"two{k}".encode()) for k in range(500)}


def test_lexicon_holds_its_terms_alone(spark):
    held = [h(str(k).encode()) for k in range(3000)] + [0, -1, 2**63 - 1, -(2**63)]
    asked = spark.createDataFrame([(t,) for t in held] + [(h(b"x%d" % k),) for k in range(3000)], "t long")
    got = {r["t"] for r in asked.where(imatch.Lexicon(spark.createDataFrame([(t,) for t in held], "term long")).holds(F.col("t"))).collect()}
    assert got == set(held)
    assert asked.where(imatch.Lexicon(spark.createDataFrame([], "term long")).holds(F.col("t"))).count() == 0


def test_an_outlying_id_does_not_crowd_the_rest(spark):
    ids = [*range(3000), 10**15, -(10**17)]
    docs = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    cells = docs.select("doc_id", imatch._cell(docs, 10, 1000).alias("cell")).orderBy("doc_id").collect()
    assert [r["cell"] for r in cells] == sorted(r["cell"] for r in cells)
    assert max(Counter(r["cell"] for r in cells).values()) <= 30
