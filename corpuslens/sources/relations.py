"""The four relations of an evaluation, taken from the given tables.

corpus(doc_id, title, text), queries(qid, text), qrels(qid, doc_id, rel, split), run(method, qid, doc_id, score).
Ids are strings and compare by code point. Keys are unique: of repeated judgements the last one counts, as in a
dictionary that is filled in order; of a document scored twice for a query, the higher score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.references import clean_id
from corpuslens.sources.tables import current_corpus, current_queries, table

__all__ = ["corpus", "numbered", "qrels", "queries", "query_set", "run", "split_qrels", "split_union"]


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return current_corpus(spark, d).select("doc_id", "title", "text")


def queries(spark: SparkSession, d: str) -> DataFrame:
    return current_queries(spark, d).select("qid", "text")


def split_qrels(spark: SparkSession, d: str) -> DataFrame:
    """qid, doc_id, rel, split: the last judgement of each pair in each split; null ids and grades are left out."""
    q = table(spark, d, "qrels_ds").select(
        clean_id(F.col("`query-id`")).alias("qid"), clean_id(F.col("`corpus-id`")).alias("doc_id"), F.col("score").alias("rel"), "split", "qrel_no"
    )
    known = q.where("qid IS NOT NULL AND doc_id IS NOT NULL AND rel IS NOT NULL AND split IS NOT NULL")
    return known.groupBy("split", "qid", "doc_id").agg(F.max_by("rel", "qrel_no").alias("rel")).select("qid", "doc_id", "rel", "split")


def split_union(of_splits: DataFrame) -> DataFrame:
    """qid, doc_id, rel: the splits in one; a query's judgements come from the last of its splits (train, dev, test)."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    ranked = of_splits.withColumn("o", order)
    last = ranked.groupBy("qid").agg(F.max("o").alias("o"))
    return ranked.join(last, ["qid", "o"]).select("qid", "doc_id", "rel")


def qrels(spark: SparkSession, d: str) -> DataFrame:
    return split_union(split_qrels(spark, d))


def run(spark: SparkSession, d: str) -> DataFrame:
    """method, qid, doc_id, score of all six methods."""
    r = table(spark, d, "retrieval").where("method IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return r.groupBy("method", "qid", "doc_id").agg(F.max("score").alias("score"))


def numbered(qid: str = "qid"):
    """The number in an id: its last run of digits."""
    return F.try_to_number(F.regexp_extract(F.col(qid), r"([0-9]{1,18})[^0-9]*$", 1), F.lit("999999999999999999")).cast("bigint")


def query_set(of: DataFrame) -> DataFrame:
    """The stated query set of searches: queries whose number is divisible by 50."""
    return of.where(numbered() % 50 == 0)
