"""Profiles of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def length_stats(texts: DataFrame, text: str, what: str) -> DataFrame:
    n = n_words(F.col(text))
    return texts.agg(
        F.lit(what).alias("what"), F.count("*").alias("n"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"),
        F.min(n).cast("double").alias("least"), F.max(n).cast("double").alias("most"),
    )


def judgements(qrels: DataFrame) -> DataFrame:
    """n_queries, n_judgements, and the mean, median and greatest number of judgements of a query."""
    n = qrels.groupBy("qid").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_judgements"), F.avg("n").alias("mean"),
        F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").cast("double").alias("most"),
    )


def splits(of_splits: DataFrame, queries: DataFrame) -> DataFrame:
    """split, n_judged (queries with judgements), n_queries (those that have a text), n_judgements."""
    per = of_splits.groupBy("split", "qid").agg(F.count("*").alias("n"))
    known = per.join(queries.select("qid", F.lit(1).alias("known")), "qid", "left")
    return known.groupBy("split").agg(F.count("*").alias("n_judged"), F.count("known").alias("n_queries"), F.sum("n").alias("n_judgements"))


def grades(qrels: DataFrame) -> DataFrame:
    """rel, n, percent."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row for each grade
    return qrels.groupBy("rel").agg(F.count("*").alias("n")).withColumn("percent", 100.0 * F.col("n") / total)


def histogram(values: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, n: counts in `bins` equal widths between the least and the greatest value, which belongs to the last bin."""
    lo, hi = values.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return values.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = (float(hi) - float(lo)) / bins or 1.0
    b = F.least(F.floor((F.col(col) - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return values.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def examples(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, n_queries: int = 3, n_docs: int = 2, preview: int = 120) -> DataFrame:
    """The first queries that are judged, each with its best judged documents and a preview of their texts."""
    first = queries.join(qrels.select("qid").distinct(), "qid", "left_semi").orderBy("qid").limit(n_queries)
    best = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    own = qrels.join(first, "qid").withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_docs)
    return own.join(corpus, "doc_id", "left").select(
        "qid", F.col("place").cast("int").alias("place"), "doc_id", "rel", F.coalesce("title", F.lit("No title")).alias("title"),
        F.substring(F.coalesce(corpus["text"], F.lit("")), 1, preview).alias("preview"),
    )
