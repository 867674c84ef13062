"""Subsets of a collection: what is judged, and a sample of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.stats import scrambled
from corpuslens.sources.relations import numbered


def sample_order(col: str):
    """A fixed pseudo-random order of ids, by the number in them."""
    return scrambled(numbered(col) * 31 + 42)


def subset_ids(corpus: DataFrame, qrels: DataFrame, target: int = 50_000, most: int = 10_000) -> DataFrame:
    """doc_id, kind: the judged documents of the corpus, and of the others a sample of at most `most`, up to `target` in all."""
    judged = qrels.select("doc_id").distinct()
    union = corpus.select("doc_id").join(judged, "doc_id", "left_semi")
    rest = corpus.select("doc_id").join(judged, "doc_id", "left_anti")
    n = max(0, min(target - union.count(), most))
    chosen = rest.orderBy(sample_order("doc_id"), "doc_id").limit(n)
    return union.withColumn("kind", F.lit("judged")).unionByName(chosen.withColumn("kind", F.lit("distractor")))


def subset_qrels(qrels: DataFrame, ids: DataFrame, sample: int = 500) -> DataFrame:
    """The judgements within the subset, of at most `sample` of the queries that have any."""
    within = qrels.join(ids.select("doc_id"), "doc_id", "left_semi")
    chosen = within.select("qid").distinct().orderBy(sample_order("qid"), "qid").limit(sample)
    return within.join(chosen, "qid", "left_semi").select("qid", "doc_id", "rel")
