"""The given tables, and the current state of those that are load histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(history: DataFrame, key: str, at: str, gone: str, columns: list[str]) -> DataFrame:
    """The last row of each key by `at`, without keys whose last row is a deletion.

    Null keys are no records. A null `at` counts as the earliest. The aggregation combines map-side, so
    a key with very many rows is no hot spot. Rows of one key with the same `at` are taken to be equal;
    should they differ, the greatest in column order wins, so that the result doesn't depend on the input's order.
    """
    payload = F.struct(*[F.col(c) for c in columns], F.coalesce(F.col(gone), F.lit(False)).alias("_gone"))
    last = (
        history.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(F.col(at).alias("_at"), payload.alias("_row"))).alias("_last"))  # max_by would shuffle each row twice
        .select(key, "_last._row")
    )
    return last.where(~F.col("_row._gone")).select(key, *[F.col("_row")[c].alias(c) for c in columns])


def current_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, text: records of collections have a text, those of the question-answer mirror a passage.

    The loader's rules: a missing title or text is empty, a passage that is empty or the string "nan" is no text.
    """
    rows = current_rows(table(spark, sf_dir, "corpus_ds"), "_id", "loaded_at", "deleted", ["title", "text", "passage", "source"])
    passage = F.when(F.col("passage") != "nan", F.col("passage"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", passage, F.lit("")).alias("text"),
        "source",
    )


def current_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, text, source of every query that isn't deleted."""
    rows = current_rows(table(spark, sf_dir, "queries_ds"), "_id", "loaded_at", "deleted", ["text", "source"])
    return rows.select(F.col("_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"), "source")
