import random
import zlib

import numpy as np
import pytest

from ionquill.llm import quality


def document(rnd, good):
    words = [rnd.choice("the river walked under quiet stones and light fell on water".split()) for _ in range(rnd.choice([8, 70, 400]))]
    if not good:
        bad = rnd.choice([lambda w: w.upper() + "!!", lambda w: w + "$$$", lambda w: w + " |"])
        words = [bad(w) for w in words]
    return " ".join(words) + "."


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, 4)) for n in (1, 3, 5, 2)]
    x, first, label = np.concatenate(bags), np.array([0, 1, 4, 9]), np.array([0.0, 1, 1, 0])
    model = quality.AttentionModel.start(x, 3, 2, 5)

    def loss():
        y = model.score(x, first)
        return -np.mean(label * np.log(y) + (1 - label) * np.log(1 - y)) + 0.005 * sum((w**2).sum() for w in model.weights.values())

    for name, grad in model.gradients(x, first, label, 0.01).items():
        w = model.weights[name]
        for at in np.ndindex(w.shape):
            keep, e = w[at], 1e-6
            w[at] = keep + e
            up = loss()
            w[at] = keep - e
            down = loss()
            w[at] = keep
            assert grad[at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_attention_finds_the_bad_passage():
    rnd = random.Random(3)
    rows = []
    for k in range(240):
        parts = [document(rnd, True) for _ in range(3)]
        if k % 2:
            parts.insert(rnd.randrange(4), " ".join(["SPAM!!"] * 64))
        rows.append((" ".join(parts), 1 - k % 2))
    bags = [quality.passage_features(t) for t, _ in rows]
    model = quality.fit(bags[:160], np.array([y for _, y in rows[:160]]))
    test = bags[160:]
    first = np.cumsum([0] + [len(b) for b in test[:-1]])
    right = (model.score(np.concatenate(test), first) >= 0.5) == np.array([y for _, y in rows[160:]])
    assert right.mean() > 0.9
    att = model.attention(np.concatenate(test), first)
    assert all(abs(s - 1) < 1e-9 for s in np.add.reduceat(att, first))


@pytest.mark.parametrize("text", [None, "", " \n\t", "x", "ÄÖ é", "word " * 64, "word " * 65, "퟿" * 10, "a" * 100000])
def test_features_are_finite(text):
    f = quality.passage_features(text)
    words = (text or "").split()
    assert f.shape == (max(1, -(-len(words) // 64)), quality.WIDTH) and np.isfinite(f).all()


def test_learns_and_holds_out(spark):
    rnd = random.Random(4)
    docs = [(k, document(rnd, k % 3 > 0), k % 3 > 0) for k in range(450)]
    held = {k for k, *_ in docs if zlib.crc32(str(k).encode()) % 3 == 1}
    # labels of held-out rows are wrong on purpose: they must not be learned from
    labels = [(k, int(good) if k not in held else int(not good), 0) for k, _, good in docs]
    labels += [(None, 1, 0), (5, None, 0), labels[0]]
    table = spark.createDataFrame([(k, t, "x") for k, t, _ in docs] + [(1000, None, "x"), (1001, "", "x"), (None, "words", "x"), (7, docs[7][1], "x")], "doc_id long, text string, score string").repartition(4)
    label_table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(table, label_table)
    rows = quality.scores(table, model).collect()
    assert len(rows) == 454
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[k]["held_out"] == (k in held) and 0 <= by_id[k]["score"] <= 1 for k, *_ in docs)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert np.mean([by_id[k]["predicted"] == good for k, _, good in docs if k in held]) > 0.95
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted((r["doc_id"] or -1) for r in rows if r["predicted"])
    again = quality.train(table.repartition(2), label_table)
    assert all(np.array_equal(again.weights[k], w) for k, w in model.weights.items())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert [tuple(r) for r in quality.scores(docs, model).collect()] == [(1, zlib.crc32(b"1") % 3 == 1, 0.5, 1)]
    assert quality.scores(docs.limit(0), model).count() == 0


def test_long_texts_are_learned_from_all_over():
    bag = np.arange(1000.0).reshape(-1, 1)
    some = quality._spread(bag, 128).ravel()
    assert len(some) == len(set(some)) == 128 and some[0] == 0 and some[-1] == 999 and np.diff(some).max() <= 8
    assert quality._spread(bag, 1000) is bag


def test_training_is_bounded_by_passages(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join([document(rnd, k % 2 == 0)] * 40), k % 2) for k in range(30)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, int(q == 0)) for k, _, q in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality.scores(docs, quality.train(docs, labels, passages=4)).collect()}
    assert sum(got[k] == (k % 2 == 0) for k in got) >= 27
