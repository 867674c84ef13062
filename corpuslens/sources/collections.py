"""Collections on disk, and the first of several sources that is there."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import string_list

_LOG = logging.getLogger(__name__)

CORPUS_SCHEMA = "_id string, title string, text string"
QUERIES_SCHEMA = "_id string, text string"
QRELS_SCHEMA = "`query-id` string, `corpus-id` string, score int"


@dataclass(frozen=True)
class Collection:
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    label: str = ""


@dataclass(frozen=True)
class Registered:
    """A collection that a sweep goes over; `skip` names the retrievers that are too heavy for it."""

    name: str
    path: str
    domain: str = ""
    skip: frozenset[str] = frozenset()


def sweep_report(evaluated: dict[str, DataFrame], registry: list[Registered], methods: list[str], notes: dict[str, str] | None = None) -> DataFrame:
    """A row for each registered collection: dataset, domain, n_queries, the mean nDCG@10 of each method (4 decimals), notes.

    `evaluated`: name to the rows of `metrics.evaluate`. A collection without them, and a method that it skips, has nulls,
    to be filled in later (`sinks.backfill`).
    """
    out = None
    for r in registry:
        means = [F.round(F.avg(F.when(F.col("method") == m, F.col("ndcg_10"))), 4) if m not in r.skip else F.lit(None).cast("double") for m in methods]
        note = (notes or {}).get(r.name, "skipped: " + ", ".join(sorted(r.skip)) if r.skip else "")
        if r.name in evaluated:
            values = evaluated[r.name].agg(F.countDistinct("qid").alias("n_queries"), *[c.alias(m) for c, m in zip(means, methods, strict=True)])
        else:
            spark = next(iter(evaluated.values())).sparkSession
            values = spark.range(1).select(F.lit(None).cast("bigint").alias("n_queries"), *[F.lit(None).cast("double").alias(m) for m in methods])
        row = values.select(F.lit(r.name).alias("dataset"), F.lit(r.domain).alias("domain"), "n_queries", *[F.col(f"`{m}`") for m in methods], F.lit(note).alias("notes"))
        out = row if out is None else out.unionByName(row)
    return out


def load_collection(spark: SparkSession, path: str, split: str = "test") -> Collection:
    """A folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv. Only queries judged in the split are kept.

    Nothing is downloaded. Of repeated ids one row counts; null ids are dropped, null titles and texts are empty.
    """
    corpus = spark.read.schema(CORPUS_SCHEMA).json(f"{path}/corpus.jsonl").where("_id IS NOT NULL")
    queries = spark.read.schema(QUERIES_SCHEMA).json(f"{path}/queries.jsonl").where("_id IS NOT NULL")
    qrels = spark.read.schema(QRELS_SCHEMA).csv(f"{path}/qrels/{split}.tsv", sep="\t", header=True)
    judged = qrels.select(F.col("`query-id`").alias("qid"), F.col("`corpus-id`").alias("doc_id"), F.col("score").alias("rel"), F.lit(split).alias("split"))
    judged = judged.where("qid IS NOT NULL AND doc_id IS NOT NULL").groupBy("qid", "doc_id", "split").agg(F.max("rel").alias("rel"))
    texts = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "text")}
    docs = corpus.groupBy("_id").agg(F.max(F.struct(*texts.values())).alias("t")).select(F.col("_id").alias("doc_id"), "t.title", "t.text")
    asked = queries.groupBy("_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).select(F.col("_id").alias("qid"), "text")
    return Collection(docs, judged_queries(asked, judged), judged.select("qid", "doc_id", "rel", "split"), path)


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")


def load_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> Collection:
    """All splits in one: the corpus once, queries with a split column, judgements of every split."""
    loaded = [load_collection(spark, path, s) for s in splits]
    queries, qrels = None, None
    for s, c in zip(splits, loaded, strict=True):
        q = c.queries.withColumn("split", F.lit(s))
        queries = q if queries is None else queries.unionByName(q)
        qrels = c.qrels if qrels is None else qrels.unionByName(c.qrels)
    return Collection(loaded[0].corpus, queries, qrels, path)


def first_available(sources: list[tuple[str, Callable[[], Collection | None]]]) -> tuple[Collection, str]:
    """The first source that gives a collection, and its label; one that fails or gives none is passed over."""
    for label, load in sources:
        try:
            found = load()
        except Exception as e:  # noqa: BLE001
            _LOG.warning("%s failed: %s: %s", label, type(e).__name__, e)
            continue
        if found is not None:
            return found, label
    raise RuntimeError("no source gave a collection")


def qa_mirror(passages: DataFrame, questions: DataFrame, ids: DataFrame) -> Collection:
    """A collection from a question-answer mirror: passages (id, passage), questions (qid, question), ids (qid, doc_id).

    Passages that are empty or the string "nan" are left out, then ids without a passage, then questions without text
    or ids. Every grade is 1.
    """
    corpus = passages.where("id IS NOT NULL AND passage <> '' AND passage <> 'nan'").select(F.col("id").alias("doc_id"), F.lit("").alias("title"), F.col("passage").alias("text"))
    asked = questions.where("question <> '' AND qid IS NOT NULL")
    qrels = ids.join(corpus.select("doc_id"), "doc_id", "left_semi").join(asked.select("qid"), "qid", "left_semi").select("qid", "doc_id").distinct()
    return Collection(corpus, judged_queries(asked.select("qid", F.col("question").alias("text")), qrels), qrels.select("qid", "doc_id", F.lit(1).alias("rel")))


def parsed_ids(questions: DataFrame, key: str, field: str) -> DataFrame:
    """key, doc_id of a field with a list, or with text that writes one."""
    listed = F.col(field) if dict(questions.dtypes)[field].startswith("array") else string_list(F.col(field))
    return questions.select(F.col(key), F.explode(listed).alias("doc_id"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)
