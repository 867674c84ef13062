"""Choosing a retrieval strategy for each query."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ["gap", "len", "tech", "is_question", "med_share", "bm25_top1"]


def label(strategies: list[str]) -> Column:
    """The place, from 0, of a query's best strategy; of equals the first."""
    scores = F.array(*[F.round(c, 9) for c in strategies])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def chosen(strategies: list[str], pick: str) -> Column:
    return F.get(F.array(*strategies), F.col(pick))


def standardised(train: DataFrame, *frames: DataFrame, features: list[str] = FEATURES) -> list[DataFrame]:
    """Each frame with its features scaled by the training rows' means and population deviations (constants stay 0)."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"d_{c}") for c in features]).first()
    cols = {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"d_{c}"] or 1.0) for c in features}
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    return [assemble.transform(f.withColumns(cols)) for f in frames]


def logistic(train: DataFrame, *frames: DataFrame, features: list[str] = FEATURES) -> list[DataFrame]:
    """Each frame with pick, by a multinomial logistic regression with an L2 penalty of 1 over all rows."""
    fit, *rest = standardised(train, train, *frames, features=features)
    model = LogisticRegression(family="multinomial", maxIter=200, regParam=1.0 / max(1, train.count()), elasticNetParam=0.0, standardization=False).fit(fit)
    return [model.transform(f).withColumn("pick", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction", "features") for f in rest]


def trees(train: DataFrame, *frames: DataFrame, features: list[str] = FEATURES, seed: int = 42) -> tuple[list[DataFrame], list[tuple[str, float]]]:
    """(each frame with pick, importance of each feature), by a forest of trees."""
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    model = RandomForestClassifier(numTrees=50, maxDepth=6, seed=seed).fit(assemble.transform(train))
    out = [model.transform(assemble.transform(f)).withColumn("pick", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction", "features") for f in frames]
    return out, sorted(zip(features, [float(x) for x in model.featureImportances.toArray()], strict=True), key=lambda x: -x[1])


def policy_value(df: DataFrame, strategies: list[str], pick: str = "pick") -> DataFrame:
    return df.agg(F.avg(chosen(strategies, pick)).alias("value"), F.count("*").alias("n_queries"))


__all__ = ["FEATURES", "chosen", "label", "logistic", "policy_value", "standardised", "trees"]
