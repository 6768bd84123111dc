"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

All of it is DataFrame functions and the JVM's own tree learner. The trees are
trained on labelled URLs; where the rules are the labels, those are the URLs
that a rule decides.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX_SLOTS = 1024
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "fragment", "tail", "suffix_1", "suffix_2"]


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules such as ``block example.com/de/``."""
    out = []
    for line in lines:
        verdict, place = line.split()
        if verdict not in ("allow", "block") or "/" not in place:
            raise ValueError(f"not a rule: {line!r}")
        host, slash, path = place.partition("/")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict; of rules equally long the longer host wins."""
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(order):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)

    def add(total: Column, c: Column) -> Column:
        p = (size - F.length(F.replace(text, c, F.lit("")))) / size
        return total - p * F.log2(p)

    return F.aggregate(F.array_remove(F.array_distinct(F.split(text, "")), ""), F.lit(0.0), add)


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _slot(suffix: Column) -> Column:
    return F.pmod(F.xxhash64(suffix), F.lit(SUFFIX_SLOTS)).cast("int")


def with_features(rows: DataFrame) -> DataFrame:
    """Adds the lexical features to rows with ``url``, ``host`` and ``path``; suffixes as hash slots."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return rows.withColumns({
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": _count(path, "/"),
        "digit_ratio": F.when(F.length(url) > 0, F.regexp_count(url, F.lit("[0-9]")) / F.length(url)).otherwise(0.0), "entropy": _entropy(url),
        "n_params": F.when(F.length(query) > 0, 1 + _count(query, "&")).otherwise(0), "n_labels": _count(host, "."), "n_hyphens": _count(host, "-"),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "tail": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
        "slot_1": _slot(_suffix(host, 1)), "slot_2": _slot(_suffix(host, 2)),
    })


class UrlModel:
    """Chance that a URL is to be blocked."""

    def __init__(self, trees, tables: dict[str, list[float]], constant: float):
        self.trees, self.tables, self.constant = trees, tables, constant

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds ``score`` to rows that ``with_features`` made; its other columns go."""
        keep = [c for c in rows.columns if c not in (*FEATURES, "slot_1", "slot_2")]
        if self.trees is None:
            return rows.select(*keep, F.lit(self.constant).alias("score"))
        named = _assembled(rows, self.tables)
        return self.trees.transform(named).select(*keep, vector_to_array("url_probability")[1].alias("score"))


def _assembled(rows: DataFrame, tables: dict[str, list[float]]) -> DataFrame:
    def share(name: str) -> Column:
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in tables[name])), ",").cast("array<double>")
        return F.element_at(table, F.col(name) + 1)

    named = rows.withColumns({"suffix_1": share("slot_1"), "suffix_2": share("slot_2")})
    return VectorAssembler(inputCols=FEATURES, outputCol="url_features").transform(named)


def train(labelled: DataFrame, bound: int = 20_000, trees: int = 10, depth: int = 3, seed: int = 7) -> UrlModel:
    """Learns from rows with ``url``, ``host``, ``path`` and ``label`` (1: block).

    About ``bound`` labelled rows, chosen by a hash of their URL, are learned
    from. Suffix statistics are shares of blocked rows for each of 1024 hash slots
    of the last label and of the last two labels of the host. Labels of one kind
    only give that verdict for all; without any, URLs are allowed.
    """
    size = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(size) < 2:
        return UrlModel(None, {}, float(next(iter(size), 0)))
    n = sum(size.values())
    if n > bound:
        buckets = 1 << 30
        labelled = labelled.where(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(buckets)) < int(buckets * bound / n))
    rows = with_features(labelled)
    tables = {}
    for name in ("slot_1", "slot_2"):
        tables[name] = [0.5] * SUFFIX_SLOTS
        for r in rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).collect():
            tables[name][r[name]] = (r["blocked"] + 1) / (r["n"] + 2)
    learner = GBTClassifier(
        featuresCol="url_features", labelCol="label", predictionCol="url_prediction", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, checkpointInterval=-1
    ).setProbabilityCol("url_probability").setRawPredictionCol("url_raw")
    data = _assembled(rows, tables).select("url_features", F.col("label").cast("double").alias("label"))
    if len(data.select("label").distinct().take(2)) < 2:
        return UrlModel(None, {}, float(max(size, key=size.get)))
    return UrlModel(learner.fit(data), tables, 0.0)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", **options: int) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row.

    The longest rule that fits a URL decides; its URLs are the labels that the
    trees learn from, and the trees decide the rest: block from a ``score`` of
    0.5, which is null where a rule decides. Null urls and those without ``://``
    have an empty host and path, so no rule with a path fits them; the trees
    judge them too. Repeated rows are judged alike, URLs of any length whole, null
    ids stay null, an empty table gives no rows, and other columns play no part.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "by_rule": verdict})
    model = train(rows.where(F.col("by_rule").isNotNull()).select("url", "host", "path", (F.col("by_rule") == "block").cast("int").alias("label")), **options)
    scored = model.scored(with_features(rows))
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
