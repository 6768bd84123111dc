"""Files that arrive while a run goes on: each is read once, into a table partitioned by source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def appended(spark: SparkSession, folder: str, read: Callable[[SparkSession, list[str]], DataFrame], out: str, checkpoint: str, pattern: str = "*", key: str = "source") -> StreamingQuery:
    """Starts a query that appends what ``read`` makes of each new file of ``folder`` to ``out``, and ends when all are done.

    Each micro-batch is written under its number, and a number that was written
    before is replaced, so a batch that runs again leaves no second copy.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder).select("path")

    def write(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().toLocalIterator()]
        if paths:
            rows = read(spark, paths).withColumn("batch", F.lit(number))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", key).parquet(out)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each key in tumbling windows; rows later than ``late`` behind the newest are left out of a stream's result."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
