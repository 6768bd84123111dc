import math
import random
from collections import Counter

from pyspark.sql import functions as F

from ionquill.operators import statistics


def plain(first, second):
    a, b = Counter(first), Counter(second)
    p, q = ({s: c[s] / sum(c.values()) for s in a | b} for c in (a, b))
    part = lambda x, y: x * math.log(2 * x / (x + y)) if x else 0.0
    way = {s: part(p[s], q[s]) - part(q[s], p[s]) for s in p}
    js = sum(part(p[s], q[s]) + part(q[s], p[s]) for s in p) / 2
    side = lambda up: sum(abs(w) for w in way.values() if (w > 0) == up)
    return js, {s: js * w / side(w > 0) if w else 0.0 for s, w in way.items()}


def test_parts_add_up_to_the_divergence_on_either_side(spark):
    rnd = random.Random(4)
    rows = [(k % 3, rnd.random() < 0.4, rnd.choice("ABCDEF" if k % 2 else "ABBG")) for k in range(400)]
    got = statistics.divergence(spark.createDataFrame(rows, "place int, first boolean, symbol string"), ["place"], "symbol", F.col("first")).collect()
    for place in range(3):
        js, parts = plain([s for k, f, s in rows if k == place and f], [s for k, f, s in rows if k == place and not f])
        own = {r["symbol"]: r for r in got if r["place"] == place}
        assert own.keys() == parts.keys()
        assert all(math.isclose(r["divergence"], js) and math.isclose(r["part"], parts[s], abs_tol=1e-12) for s, r in own.items())
        assert math.isclose(sum(max(r["part"], 0) for r in own.values()), js) and math.isclose(sum(min(r["part"], 0) for r in own.values()), -js)


def test_a_sample_without_symbols_is_infinitely_far(spark):
    rows = [(0, True, "A"), (0, False, "A"), (1, True, "A"), (1, True, "B")]
    got = statistics.divergence(spark.createDataFrame(rows, "place int, first boolean, symbol string"), ["place"], "symbol", F.col("first")).collect()
    assert {(r["place"], r["symbol"]): (str(r["part"]), str(r["divergence"])) for r in got} == {(0, "A"): ("0.0", "0.0"), (1, "A"): ("nan", "inf"), (1, "B"): ("nan", "inf")}
