"""Semi-supervised target-decoy rescoring.

PSMs fall in three folds by a hash of their scan, so that competing peptides of
one spectrum stay together. For each fold a linear model learns from the other
two: targets below the FDR under the current score against all decoys, again and
again, from the best single feature on. Each fold is scored by the model that
hasn't seen it.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.operators.learning import linear_score
from ionquill.operators.statistics import q_values, score_cut
from ionquill.storage import stored


def best_feature(df: DataFrame, features: list[str], fdr: float, shortlist: int = 2) -> tuple[str, int]:
    """The feature, and its direction, that puts most targets below the FDR.

    One pass ranks all features by the distance between target and decoy means
    in standard deviations; the first ``shortlist`` of them are tried.
    """
    side = lambda f, k: F.avg(F.when(F.col("Label") == k, F.col(f)))
    row = df.agg(*[((side(f, 1) - side(f, -1)) / F.greatest(F.stddev_pop(f), F.lit(1e-12))).alias(f) for f in features]).first()
    apart = {f: row[f] or 0.0 for f in features}
    best = (-1, features[0], 1)
    for f in sorted(features, key=lambda f: -abs(apart[f]))[:shortlist]:
        way = 1 if apart[f] >= 0 else -1
        own = df.select("Label", (F.col(f) * way).alias("__score"))
        cut = score_cut(own, "__score", F.col("Label") == 1, fdr)
        n = 0 if cut is None else own.where((F.col("__score") >= cut) & (F.col("Label") == 1)).count()
        best = max(best, (n, f, way), key=lambda x: x[0])
    return best[1], best[2]


def _scaled(df: DataFrame, features: list[str]) -> tuple[list[Column], list[float], list[float]]:
    row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean = [row[f"m_{f}"] or 0.0 for f in features]
    spread = [row[f"s_{f}"] or 1.0 for f in features]
    return [((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, spread, strict=True)], mean, spread


def train(df: DataFrame, features: list[str], fdr: float, rounds: int) -> tuple[list[float], float]:
    """Weights and bias of the last round; features should be on one scale and hold no nulls."""
    first, way = best_feature(df, features, fdr)
    weights, bias = [float(way) if f == first else 0.0 for f in features], 0.0
    assembler = VectorAssembler(inputCols=features, outputCol="__x")
    for _ in range(rounds):
        marked = df.select("Label", *features, linear_score(features, [(weights, bias)]).alias("__score"))
        cut = score_cut(marked, "__score", F.col("Label") == 1, fdr)
        if cut is None:
            break
        chosen = marked.where((F.col("__score") >= cut) | (F.col("Label") == -1)).withColumn("__y", (F.col("Label") == 1).cast("double"))
        counts = {r["__y"]: r["count"] for r in chosen.groupBy("__y").count().collect()}
        if len(counts) < 2:
            break
        balance = F.when(F.col("__y") == 1, counts[0.0] / counts[1.0]).otherwise(1.0)
        model = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1e-3, maxIter=30, standardization=False).fit(assembler.transform(chosen.withColumn("__w", balance)))
        new, new_bias = [float(x) for x in model.coefficients], float(model.intercept)
        moved = math.dist(new, weights)
        weights, bias = new, new_bias
        if moved < 1e-4:
            break
    return weights, bias


def error_probabilities(df: DataFrame, score: str = "score", name: str = "postErrProb", bins: int = 1000) -> DataFrame:
    """Adds the posterior error probability: decoys per target near a score, falling as scores rise.

    The isotonic fit is over at most ``bins`` ranges of score, so that it stays small.
    """
    from ionquill.operators.running import with_range

    cut = with_range(df, score, bins)
    grid = cut.groupBy("__range").agg(F.avg(score).alias("__x"), F.avg((F.col("Label") == -1).cast("double")).alias("__d"), F.count(F.lit(1)).cast("double").alias("__n"))
    # decoys stand for as many wrong targets: p(wrong | target) = d / (1 - d), at most 1
    point = grid.select(F.col("__x").alias("x"), F.least(F.lit(1.0), F.col("__d") / F.greatest(1 - F.col("__d"), F.lit(1e-9))).alias("y"), F.col("__n").alias("w"))
    model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", isotonic=False, predictionCol=name).fit(point)
    return model.transform(df.withColumn("x", F.col(score).cast("double"))).drop("x")


def rescored(psms: DataFrame, features: list[str], group: list[str], folds: int = 3, rounds: int = 10, fdr: float = 0.01) -> DataFrame:
    """Adds ``score``, ``qValue`` and ``postErrProb`` to PSMs with a ``Label`` of 1 or -1.

    Null features count as their mean. ``group`` names the columns that keep rows
    in one fold. Scaled features are written to the shared folder once, so that no
    round plans or works out the features again.
    """
    scaled, mean, _ = _scaled(psms, features)
    filled = psms.fillna(dict(zip(features, mean, strict=True)))
    keep = [c for c in psms.columns if c not in features]
    data = filled.select(*keep, *scaled, F.pmod(F.xxhash64(*group), F.lit(folds)).alias("__fold"), *[F.col(f).alias(f"__raw_{f}") for f in features])
    data = stored(data, "rescoring")
    score = F.lit(None).cast("double")
    for k in range(folds):
        weights, bias = train(data.where(F.col("__fold") != k), features, fdr, rounds)
        score = F.when(F.col("__fold") == k, linear_score(features, [(weights, bias)])).otherwise(score)
    out = data.withColumn("score", score).select(*keep, *[F.col(f"__raw_{f}").alias(f) for f in features], "score")
    return error_probabilities(q_values(out, "score", F.col("Label") == 1))
