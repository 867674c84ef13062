"""Fusing two runs: weighted min-max scores and reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.metrics import rank_run


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, doc_id, a, b: the union of two runs' documents; a missing score is 0."""
    x, y = a.select("qid", "doc_id", F.col("score").alias("a")), b.select("qid", "doc_id", F.col("score").alias("b"))
    return x.join(y, ["qid", "doc_id"], "full_outer").na.fill(0.0, ["a", "b"])


def min_max(scores: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """`scores` with each of `cols` brought to 0..1 within its query; 0 where all are the same.

    The bounds are aggregated map-side and joined back, so that a query with very many documents is no hot spot.
    """
    bounds = scores.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    lo, hi = (lambda c: F.col(f"_lo_{c}")), (lambda c: F.col(f"_hi_{c}"))
    scaled = {c: F.when(hi(c) > lo(c), (F.col(c) - lo(c)) / (hi(c) - lo(c))).otherwise(0.0) for c in cols}
    return scores.join(bounds, keys).withColumns(scaled).select(*scores.columns)


def normalised(a: DataFrame, b: DataFrame) -> DataFrame:
    return min_max(joined(a, b), ["a", "b"], ["qid"])


def hybrid(a: DataFrame, b: DataFrame, alpha: float = 0.4) -> DataFrame:
    """qid, doc_id, score: alpha of the first run's normalised score and the rest of the second's; nothing is cut off."""
    return normalised(a, b).select("qid", "doc_id", (F.lit(alpha) * F.col("a") + F.lit(1 - alpha) * F.col("b")).alias("score"))


def rrf(runs: list[DataFrame], k: int = 60) -> DataFrame:
    """qid, doc_id, score: the sum of 1 / (k + rank) over the runs."""
    parts = [rank_run(r.select("qid", "doc_id", "score"), ["qid"]).select("qid", "doc_id", (1.0 / (F.lit(k) + F.col("rank"))).alias("part")) for r in runs]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def alpha_sweep(a: DataFrame, b: DataFrame, alphas: list[float]) -> DataFrame:
    """alpha, qid, doc_id, score: the fused run at every weight, from one normalised join."""
    each = F.explode(F.array(*[F.lit(x) for x in alphas])).alias("alpha")
    n = normalised(a, b).select("qid", "doc_id", "a", "b", each)
    return n.select("alpha", "qid", "doc_id", (F.col("alpha") * F.col("a") + (1.0 - F.col("alpha")) * F.col("b")).alias("score"))
