import numpy as np
import pytest

from ionquill.operators import statistics as S


def plain(x, y):
    i, j = np.triu_indices(len(x), 1)
    apart = x[i] != x[j]
    slope = np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart])
    return slope, np.median(y - slope * x)


def points(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 500, n) / 4
    return x, 3 * x + rng.standard_t(2, n) * 40


def test_all_points_of_a_key_count(spark):
    sizes = {"a": 900, "b": 201, "c": 7}
    each = {k: points(n, n) for k, n in sizes.items()}
    rows = [(k, float(x), float(y)) for k, (xs, ys) in each.items() for x, y in zip(xs, ys, strict=True)]
    rows += [("same x", 1.0, 2.0), ("same x", 1.0, 3.0), ("none", None, 2.0), (None, 1.0, 2.0), (None, 2.0, 2.0)]
    got = {r["k"]: r for r in S.median_slopes(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert set(got) == set(sizes)
    for k, (x, y) in each.items():
        assert (got[k]["slope"], got[k]["intercept"]) == pytest.approx(plain(x, y), rel=1e-12)
        assert got[k]["n"] == sizes[k]


@pytest.mark.parametrize("n", [60, 61, 62, 63])
@pytest.mark.parametrize("lean", [-1, 1])
def test_blocks_give_the_median(n, lean):
    x, y = points(n, n)
    assert S._middle_slope(x, lean * y, at_once=100) == pytest.approx(plain(x, lean * y)[0], rel=1e-12)
