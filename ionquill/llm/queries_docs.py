"""Queries of the operators that learn from, extract, rewrite or search rows."""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import DataFrame, SparkSession

from ionquill.llm import bitslices, pages, pseudonyms, quality

KEY = "spark.ionquill.pseudonymKey"

OP6_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def key(spark: SparkSession) -> bytes:
    """The pseudonyms' key that the session names; one that names none gets a random key, with a warning, for as long as it lasts."""
    if spark.conf.get(KEY, None) is None:
        warnings.warn(f"{KEY} is unset: pseudonyms are by a key that is lost with this session", stacklevel=2)
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY).encode()


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scores(docs, model)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, key(spark), count_col="n_pseudonyms")


def op6_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
