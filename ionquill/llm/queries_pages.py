"""Queries of the operators on web pages and their addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionquill.llm import archives, urls

RULES = urls.parse_rules(["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"])

_BITS = "CASE substr(x, d, 1) " + " ".join(f"WHEN '{k:x}' THEN '{k:04b}'" for k in range(16)) + " END"
_FIVE = " + ".join(f"(substr(b, 5 * g + {k + 1}, 1) = '1')::INTEGER * {16 >> k}" for k in range(5))
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
u AS (SELECT page_id, n, x, array_to_string(list_transform(range(1, 41), lambda d: {_BITS}), '') AS b FROM q),
w AS (SELECT page_id, n, x, array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS digest FROM u),
m AS (SELECT x, max(page_id) AS head FROM q GROUP BY x)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM w JOIN m ON w.x = m.x
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
