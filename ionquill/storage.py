"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master gets a temporary folder and any other
    master a folder inside a warehouse that lies on a file system of its own;
    a warehouse on each machine's own disk is refused.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if conf.get("spark.master", "").startswith("local"):
        named = "file://" + tempfile.mkdtemp(prefix="ionquill-")
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = warehouse.rstrip("/") + "/_ionquill_work"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ionquill-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ionquill_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table made by ``stored`` that nothing will read again."""
    path = getattr(df, "_ionquill_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
