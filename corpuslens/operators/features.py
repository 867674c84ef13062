"""Per-query features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import is_question, medical_share, prep_text, word_tokens


def idf_table(corpus: DataFrame) -> DataFrame:
    """term, df, idf = ln((n + 1) / (df + 1)) + 1, with df counted once in each document."""
    n = corpus.count()  # one number
    terms = corpus.select(F.explode(F.array_distinct(word_tokens(prep_text("title", "text")))).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(float(n)) + 1.0) / (F.col("df") + 1.0)) + 1.0)


def technicality(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """qid, tech: the mean idf of a query's words with repeats; unseen words count 1, a query without words has 0."""
    words = queries.select("qid", F.explode(word_tokens(F.col("text"))).alias("term"))
    mean = words.join(idf.select("term", "idf"), "term", "left").groupBy("qid").agg(F.avg(F.coalesce("idf", F.lit(1.0))).alias("tech"))
    return queries.select("qid").join(mean, "qid", "left").withColumn("tech", F.coalesce("tech", F.lit(0.0)))


def vocab_gap(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, gap: 1 less the largest share of a query's distinct words found in one of its judged documents (whatever
    their grade). Without query words 0, without judged documents of the corpus 1."""
    q = queries.select("qid", F.array_distinct(word_tokens(F.col("text"))).alias("q"))
    pairs = qrels.select("qid", "doc_id").distinct().join(q, "qid")
    judged = corpus.select("doc_id", F.array_distinct(word_tokens(prep_text("title", "text"))).alias("d"))
    overlap = F.when(F.size("q") > 0, F.size(F.array_intersect("q", "d")) / F.size("q")).otherwise(0.0)
    best = pairs.join(judged, "doc_id").groupBy("qid").agg(F.max(overlap).alias("best"))
    gap = F.when(F.size("q") == 0, 0.0).otherwise(1.0 - F.coalesce("best", F.lit(0.0)))
    return q.join(best, "qid", "left").select("qid", gap.alias("gap"))


def surface(queries: DataFrame) -> DataFrame:
    """qid, len, is_question, med_share."""
    t = queries.select("qid", "text", word_tokens(F.col("text")).alias("tokens"))
    return t.select("qid", F.size("tokens").alias("len"), is_question(F.col("text")).alias("is_question"), medical_share(F.col("tokens")).alias("med_share"))


def router_features(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, top1: DataFrame) -> DataFrame:
    """qid, gap, len, tech, is_question, med_share, bm25_top1. `top1`: qid, score of the best document; without one 0.

    The gap uses the judgements, so it is known only where they are.
    """
    best = top1.groupBy("qid").agg(F.max("score").alias("bm25_top1"))
    return (
        surface(queries).join(vocab_gap(queries, qrels, corpus), "qid").join(technicality(queries, idf_table(corpus)), "qid")
        .join(best, "qid", "left")
        .select("qid", "gap", "len", "tech", "is_question", "med_share", F.coalesce("bm25_top1", F.lit(0.0)).alias("bm25_top1"))
    )
