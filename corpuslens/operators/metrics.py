"""Ranked-retrieval metrics as one pass over ranked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.plans.numbering import number_in_groups

KS = (1, 3, 5, 10)


def rank_run(run: DataFrame, keys: list[str], k: int | None = None, few: bool = False) -> DataFrame:
    """`run` with rank, from 1, by score downwards and document upwards. Scores are compared to 6 decimals, so that the
    order of additions cannot change ranks. With `k`, a task keeps at most k rows of a key before they are shuffled.
    Without it, a key may have any number of rows and is spread over tasks, unless `few` says that each has a few only."""
    order = [F.round("score", 6).desc(), F.col("doc_id").asc()]
    if k is None and not few:
        return number_in_groups(run, keys, order, "rank").withColumn("rank", F.col("rank").cast("int"))
    ranked = run.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1.0) / F.log2(rank + 1.0)


def ideal(qrels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """qid, n_rel, idcg_k: what a perfect ranking of all judged documents would gain."""
    w = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    best = qrels.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(ks))
    gains = best.groupBy("qid").agg(*[F.sum(F.when(F.col("r") <= k, gain(F.col("rel"), F.col("r")))).alias(f"idcg_{k}") for k in ks])
    return qrels.groupBy("qid").agg(F.count(F.when(F.col("rel") >= 1, 1)).alias("n_rel")).join(gains, "qid")


def evaluate(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, keys: tuple[str, ...] = ("method",), run_queries: DataFrame | None = None) -> DataFrame:
    """keys, qid, ndcg_k, recall_k, p_k, map_k of the queries that are both judged and in the run.

    Unjudged documents have grade 0; grades below 0 count as they are. Without relevant documents recall and average
    precision are 0, and nDCG is 0 if a perfect ranking would gain nothing. Precision is divided by k even if fewer are
    returned, average precision by the smaller of k and the number of relevant documents. `run_queries` (keys, qid) names
    the queries of a run, with those that found nothing: they count as zeros, where a query that isn't in it is left out.
    """
    by = [*keys, "qid"]
    top = rank_run(run, by, max(ks)).join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left")
    top = top.withColumn("rel", F.coalesce("rel", F.lit(0))).withColumn("hit", (F.col("rel") >= 1).cast("int"))
    hits = F.sum("hit").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    top = top.withColumn("so_far", hits / F.col("rank") * F.col("hit"))
    parts = []
    for k in ks:
        within = F.col("rank") <= k
        parts += [
            F.sum(F.when(within, gain(F.col("rel"), F.col("rank")))).alias(f"dcg_{k}"),
            F.sum(F.when(within, F.col("hit")).otherwise(0)).alias(f"hits_{k}"),
            F.sum(F.when(within, F.col("so_far")).otherwise(0.0)).alias(f"ap_{k}"),
        ]
    gained = top.groupBy(*by).agg(*parts)
    if run_queries is not None:
        gained = run_queries.select(*by).distinct().join(gained, by, "left").na.fill(0)
    return gained.join(ideal(qrels, ks), "qid").select(*by, *[c for k in ks for c in _metrics(k)])


def _metrics(k: int) -> list[Column]:
    c = F.col
    return [
        F.when(c(f"idcg_{k}") > 0, c(f"dcg_{k}") / c(f"idcg_{k}")).otherwise(0.0).alias(f"ndcg_{k}"),
        F.when(c("n_rel") > 0, c(f"hits_{k}") / c("n_rel")).otherwise(0.0).alias(f"recall_{k}"),
        (c(f"hits_{k}") / F.lit(k)).alias(f"p_{k}"),
        F.when(c("n_rel") > 0, c(f"ap_{k}") / F.least(c("n_rel"), F.lit(k))).otherwise(0.0).alias(f"map_{k}"),
    ]


def per_query_ndcg(run: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("method",), k: int = 10) -> DataFrame:
    """keys, qid, ndcg for every query of the run; 0 where nothing is judged."""
    scored = evaluate(run, qrels, (k,), keys).select(*keys, "qid", F.col(f"ndcg_{k}").alias("ndcg"))
    every = run.select(*keys, "qid").distinct()
    return every.join(scored, [*keys, "qid"], "left").withColumn("ndcg", F.coalesce("ndcg", F.lit(0.0)))


def aggregate(per_query: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """by, n_queries, the mean of each metric, the empirical risk (mean of 1 - nDCG@10) and the loss's sample variance."""
    loss = 1.0 - F.col("ndcg_10")
    return per_query.groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        *[F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("ndcg", "recall", "p", "map") for k in ks],
        F.avg(loss).alias("risk"),
        F.var_samp(loss).alias("loss_variance"),
    )
