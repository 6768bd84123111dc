"""From raw documents to packed training sequences, in stages.

Quality first, so that no rejected text stands for a group of copies; then one
document of each group of near duplicates; then pseudonyms for personal data;
last, packing. Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ionquill.llm import packing, pseudonyms, quality, queries_docs, simhash
from ionquill.llm.storage import stored
from ionquill.shipping import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained here, accepts."""
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity 0.8 or more."""
    ship(spark)
    return simhash.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, which are as long as what they replace."""
    ship(spark)
    return pseudonyms.pseudonymised(docs, queries_docs.key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    ship(spark)
    return packing.pack(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("personal_data", private), ("packing", packed)]

#: Learned scores, hashes and the tokenizer can't be expressed in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
