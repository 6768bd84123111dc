import math
import random
import re

import pytest

from ionquill.llm import urls
from ionquill.llm.queries_pages import RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


ODD = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://WWW.Example.NET/EN/x", "http://example.net/en/", "http://example.net/en", "http://badexample.com/de/1",
    "http://a.example.com/de/?x=1", "http://x.org/fr/#top", "http://x.org?y=/fr/", "http://x.net:80/", "http://x.net#a/b", "a://b://c.net/d", "http://ÄB.net/x", "http://x.net\n/y",
    "http://x.com/" + "a1" * 5000, "x://y.org/fr/z",
]


def test_rules_equal_plain_ones(spark):
    rnd = random.Random(3)
    made = [f"http://{rnd.choice(['', 'www.', 'a.b.'])}{rnd.choice(['example', 'other'])}.{rnd.choice(['net', 'com', 'org'])}/{rnd.choice(['en', 'de', 'fr'])}/{k}" for k in range(150)]
    rows = list(enumerate([*ODD, *made, *made[:5]]))
    pages = spark.createDataFrame([(k, u, 1.0, "x") for k, u in rows] + [(None, made[0], 0.0, "x")], "page_id long, url string, score double, host string").repartition(4)
    got = urls.judge(pages, RULES).collect()
    assert len(got) == len(rows) + 1
    by_id = {r["page_id"]: r for r in got}
    for k, url in rows:
        host, path = plain_parts(url)
        rule, r = plain_rule(host, path), by_id[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")


def test_features(spark):
    url = "http://a-b.c.example.org/x/y12.html?p=1&q=2#z"
    row = urls.with_features(spark.createDataFrame([(url,)], "url string").withColumns({"host": urls.host_of(urls.F.col("url")), "path": urls.path_of(urls.F.col("url"))})).first()
    entropy = -sum(p * math.log2(p) for p in (url.count(c) / len(url) for c in set(url)))
    assert row["entropy"] == pytest.approx(entropy)
    assert (row["url_length"], row["depth"], row["n_params"], row["n_labels"], row["n_hyphens"], row["fragment"], row["tail"]) == (len(url), 2, 2, 3, 1, 1, 4)
    assert row["digit_ratio"] == pytest.approx(4 / len(url))


def test_learns_labelled_urls(spark):
    rnd = random.Random(5)

    def url(spam):
        host = "cheap-" * rnd.randint(1, 3) + "x.example.com" if spam else rnd.choice(["news", "blog"]) + ".example.com"
        return f"http://{host}/{rnd.randint(1, 10 ** (9 if spam else 2))}"

    rows = [(url(k % 2), k % 2, k % 4 < 2) for k in range(800)]
    table = spark.createDataFrame(rows, "url string, label int, learn boolean").withColumns({"host": urls.host_of(urls.F.col("url")), "path": urls.path_of(urls.F.col("url"))})
    model = urls.train(table.where("learn").drop("learn"), bound=300)
    held = model.scored(urls.with_features(table.where("not learn"))).collect()
    assert sum((r["score"] >= 0.5) == (r["label"] == 1) for r in held) / len(held) > 0.95


def test_one_kind_of_label_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/y")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, RULES).collect()} == {1: "block", 2: "block"}
    assert [r["verdict"] for r in urls.judge(pages.where("page_id = 2"), RULES).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(k, f"http://a{k}.{t}/{p}/x") for k, (t, p) in enumerate([("net", "de"), ("example.net", "en"), ("com", "x")] * 5)], "page_id long, url string")
    plan = urls.judge(pages, RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
