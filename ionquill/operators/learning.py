"""Clustering, projection and linear scoring by the JVM's learners."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clusters(df: DataFrame, values: str, k: int = 7, seed: int = 42, name: str = "cluster") -> DataFrame:
    """Adds the k-means cluster of an array column."""
    data = df.withColumn("__v", array_to_vector(F.col(values)))
    return KMeans(featuresCol="__v", predictionCol=name, k=k, seed=seed).fit(data).transform(data).drop("__v")


def principal_components(df: DataFrame, values: str, k: int = 2) -> DataFrame:
    """Adds ``pc1`` ... of an array column, each dimension centred and scaled first."""
    data = df.withColumn("__v", array_to_vector(F.col(values)))
    scaled = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(data).transform(data)
    out = PCA(k=k, inputCol="__s", outputCol="__p").fit(scaled).transform(scaled).withColumn("__p", vector_to_array("__p"))
    return out.select(*df.columns, *[F.get("__p", i).alias(f"pc{i + 1}") for i in range(k)])


def linear_score(features: list[str], weights: list[tuple[list[float], float]]) -> Column:
    """Mean over models of weights . features + bias."""
    each = [sum((F.col(f) * F.lit(w) for f, w in zip(features, ws, strict=True)), F.lit(bias)) for ws, bias in weights]
    return sum(each[1:], each[0]) / len(each)
