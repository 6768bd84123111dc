import math
import random

import numpy as np
import pytest

from ionquill.llm import bitslices


def plain(rows, every, k, scale=64):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        query = min(v for i, v in fine if i == q)
        scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in fine if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_index_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 300)), int(rng.integers(1, 20))
    low, high = [(-3, 4), (-64, 65), (0, 2), (5, 6), (-1000, 10)][seed % 5]
    values, ids = rng.integers(low, high, (n, d)), rng.integers(0, 200, n)
    index = bitslices.BitSlices(ids, values)
    for k in (1, 7, 500):
        query = rng.integers(low, high, d)
        got = list(zip(*(x.tolist() for x in index.top(query, k, 5))))
        assert got == [(i, -s) for s, i in sorted((-int(v @ query), int(i)) for i, v in zip(ids, values) if i != 5)[:k]]


def test_table(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(6)], i % 3) for i in range(130)]
    rows += [(200 + i, list(rows[7][1]), 0) for i in range(40)] + [(20, [0.5, 0.1], 0), (33, rows[3][1], 0), (33, rows[3][1], 0)]
    rows += [(400, None, 0), (401, [0.1, None], 0), (402, [float("nan")], 0), (403, [float("inf")], 0), (None, [1.0], 0), (405, [], 0), (420, [-2.0] * 6, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(5)
    for block, queries in ((16384, 512), (40, 3)):
        got = bitslices.top_products(table, every=10, k=20, block=block, queries=queries).collect()
        assert sorted(map(tuple, got)) == sorted(plain(rows, 10, 20))
    assert bitslices.top_products(table.limit(0)).count() == 0
    assert bitslices.top_products(table.where("vec_id = 20"), every=10).count() == 0


def test_components_of_any_finite_size(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, -2.0]), (2, [-1e30, 3.0]), (3, [0.3, 1e15]), (10, [1e300, 0.0]), (11, [0.26, 0.51]), (20, [1.7e308, -1.7e308])]
    got = bitslices.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=20, block=4).collect()
    low, high = -(1 << 63), (1 << 63) - 1
    whole = lambda x: int(x) * 64 if abs(x) > 2.0**53 else math.floor(64 * x)
    want = {(q, i): min(max(sum(whole(a) * whole(b) for a, b in zip(v, w)), low), high) for q, v in rows if q % 10 == 0 for i, w in rows if i != q}
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in got} == want


def test_parts_that_cannot_win_are_passed_over(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0.9, 1, (64, 4)), rng.uniform(0, 0.1, (192, 4))])
    asked, top = [], bitslices.BitSlices.top
    monkeypatch.setattr(bitslices.BitSlices, "top", lambda self, *a: asked.append(1) or top(self, *a))
    ids = np.arange(256)
    got = bitslices.searched(ids, x, ids[:1], x[:1], 5, 64, part=64)
    values = np.floor(x * 64).astype(int)
    want = sorted((-int(values[0] @ values[i]), i) for i in range(1, 256))[:5]
    assert list(zip(got[2].tolist(), got[1].tolist())) == [(-s, i) for s, i in want] and len(asked) == 1
