"""Connected components over a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionquill.llm.storage import discard, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least_neighbour(near: DataFrame) -> DataFrame:
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return near.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node that it sees."""
    return (
        _least_neighbour(_both_ways(links))
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _least_neighbour(down)
    ends = F.explode(F.array("u", "v")).alias("u")
    return seen.select(ends, F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """Component of every linked node: columns ``node`` and ``root``, the least node of its component.

    ``links`` has two comparable columns ``u`` and ``v`` of one type. Large-star
    and small-star rounds run until the links no longer change, which takes a
    number of rounds that grows with the logarithm of the longest chain. Each
    round is written to the shared folder; the driver sees a count and a sum.
    Null ends and loops are ignored; nodes without links don't appear.
    """
    at = stored(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    was = _signature(at)
    while True:
        after = stored(_small_star(_large_star(at)), "links")
        now = _signature(after)
        discard(at)
        at = after
        if now == was:
            break
        was = now
    stars = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
