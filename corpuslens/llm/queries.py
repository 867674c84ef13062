"""Queries of the problems tagged llm, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import encode, language, mixture, neardup, overlap, topn
from corpuslens.sources.tables import current_queries, table

NEAR_RECORDS = neardup.NearDup(shingle=3, similarity=0.5, least_words=20)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The top_k best documents of each method and query that feat_rows names."""
    runs = table(spark, d, "retrieval")
    limits = topn.group_limits(runs, ["method", "qid"], "top_k", table(spark, d, "feat_rows"), "qid")
    return topn.top_n_per_group(runs, ["method", "qid"], "doc_id", "score", limits, "top_k")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The load history of the records, each row with its content."""
    rows = table(spark, d, "corpus_ds")
    content = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "text", "passage")])
    return neardup.history(rows, "_id", "loaded_at", "deleted", content)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose sets of three successive words share at least half of their union."""
    members, links = neardup.near_duplicates(_records(spark, d), NEAR_RECORDS)
    return neardup.expand_pairs(members, links, NEAR_RECORDS)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the group of near-duplicates that it belongs to and its number of links."""
    members, links = neardup.near_duplicates(_records(spark, d), NEAR_RECORDS)
    return neardup.groups(members, links)


def _roster(spark: SparkSession, d: str) -> DataFrame:
    """split, qid of feat_rows, the split's name in one spelling."""
    name = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    return table(spark, d, "feat_rows").select(F.when(name.isin("val", "validation"), "dev").otherwise(name).alias("split"), "qid")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    texts = current_queries(spark, d).select("qid", "text")
    return overlap.split_overlaps(_roster(spark, d), texts, ["dev", "test"], "train", 0.75)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Queries of dev and test that stand in train too, or nearly so."""
    return _overlaps(spark, d).select("eval_split", "qid_a", "qid_b").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source of the evaluation query, and how much of the queries common spans cover."""
    sources = current_queries(spark, d).select(F.col("qid").alias("eval_qid"), F.lower(F.trim("source")).alias("source"))
    return (
        _overlaps(spark, d).join(sources, "eval_qid")
        .groupBy("eval_split", "source")
        .agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_qid").alias("n_queries"), F.count(F.when(F.col("similarity") == 1.0, 1)).alias("n_exact"), F.sum("covered").alias("covered_words"))
    )


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text", encode.Tokenizer.public())


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are used, and how often, so that each listed source gets its weight of all tokens."""
    selection, _ = mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), encode.Tokenizer.public())
    return selection.withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all tokens that each listed source was to get and got."""
    return mixture.share_report(*mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), encode.Tokenizer.public()))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every text in one language, with a confidence."""
    documents = table(spark, d, "documents")
    samples = language.labelled_text(table(spark, d, "lang_samples"))
    samples = language.extend(samples, language.labelled_documents(documents, "doc_id", "text", "lang"))
    return language.language_segments(documents, "doc_id", "text", samples, carry="lang")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """All segments of the documents whose label is missing or wrong, or that have more than one segment."""
    wrong = F.coalesce(language.label_code(F.col("claim")) != F.col("lang"), F.lit(True))
    return p8_segments(spark, d).where((F.col("n_segments") > 1) | wrong).select("doc_id", "seg_no", "lang")


QUERIES = {
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_ids": p6_ids,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
}

_P4 = """
WITH cur AS (
  SELECT _id, lower(concat_ws(' ', coalesce(title, ''), coalesce(text, ''), coalesce(passage, ''))) AS content FROM (
    SELECT *, row_number() OVER (PARTITION BY _id ORDER BY loaded_at DESC) AS k FROM corpus_ds) WHERE k = 1 AND NOT coalesce(deleted, false)),
w AS (SELECT _id, regexp_extract_all(content, '[\\p{L}\\p{N}]+') AS w FROM cur),
s AS (
  SELECT DISTINCT _id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT _id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT _id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x._id AS a, y._id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x._id < y._id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM c JOIN n p ON p._id = a JOIN n q ON q._id = b WHERE 2 * c >= p.n + q.n - c)"""
_P5 = """
WITH cur AS (
  SELECT _id, source, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY _id ORDER BY loaded_at DESC) AS k FROM queries_ds) WHERE k = 1 AND NOT coalesce(deleted, false)),
q AS (SELECT * FROM cur WHERE len(w) > 0),
f AS (SELECT DISTINCT CASE WHEN s IN ('val', 'validation') THEN 'dev' ELSE s END AS split, qid FROM (
  SELECT lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS s, qid FROM feat_rows) WHERE s IS NOT NULL AND qid IS NOT NULL),
e AS (SELECT f.split, q.* FROM f JOIN q ON f.qid = q._id WHERE f.split IN ('dev', 'test')),
t AS (SELECT q.* FROM f JOIN q ON f.qid = q._id WHERE f.split = 'train'),
o AS (
  SELECT e.split AS eval_split, least(e._id, t._id) AS qid_a, greatest(e._id, t._id) AS qid_b, e._id AS eval_qid, e.source,
         len(list_intersect(e.w, t.w)) AS c, len(e.w) + len(t.w) - len(list_intersect(e.w, t.w)) AS u
  FROM e JOIN t ON e._id = t._id OR 4 * len(list_intersect(e.w, t.w)) >= 3 * (len(e.w) + len(t.w) - len(list_intersect(e.w, t.w))))
"""

SQL = {
    "p2_found": """
WITH best AS (
  SELECT method, qid, doc_id, max(score) AS score FROM retrieval
  WHERE method IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3),
lim AS (SELECT method, qid, max(top_k) AS n FROM retrieval WHERE qid IN (SELECT qid FROM feat_rows WHERE qid IS NOT NULL) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY score DESC, doc_id) AS k FROM best)
SELECT r.method, r.qid, CAST(r.k AS INTEGER) AS pos, r.doc_id FROM r JOIN lim ON r.method = lim.method AND r.qid = lim.qid AND r.k <= lim.n""",
    "p4_found": _P4 + "SELECT a AS id_a, b AS id_b FROM pairs",
    "p4_groups": _P4.replace("WITH cur", "WITH RECURSIVE cur") + """,
m AS (SELECT _id, w FROM w WHERE len(w) >= 20),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT _id, _id AS other FROM m UNION SELECT reach._id, e.b FROM reach JOIN e ON reach.other = e.a),
g AS (SELECT _id, min(other) AS group_id FROM reach GROUP BY 1),
l AS (SELECT e.a, count(DISTINCT y.w) AS n FROM e JOIN m x ON e.a = x._id JOIN m y ON e.b = y._id WHERE x.w <> y.w GROUP BY 1)
SELECT g._id AS id, group_id, coalesce(l.n, 0) AS n_links FROM g LEFT JOIN l ON g._id = l.a""",
    "p5_found": _P5 + "SELECT DISTINCT eval_split, qid_a, qid_b FROM o",
    "p5_report": _P5 + """
SELECT eval_split, lower(trim(source)) AS source, count(*) AS n_pairs, count(DISTINCT eval_qid) AS n_queries, count(CASE WHEN c = u THEN 1 END) AS n_exact, sum(c)::BIGINT AS covered_words FROM o GROUP BY 1, 2""",
}
