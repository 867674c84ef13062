"""Queries of the general problems 1 and 3, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.packed import explode_packed
from corpuslens.operators import references as R
from corpuslens.sources.tables import table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = R.unpivot_references(table(spark, d, "qrels_ds"), "qrel_no", ["query-id", "corpus-id"], "judged_at")
    history = R.load_history(table(spark, d, "queries_ds"), "query-id", "_id", "loaded_at", "deleted").unionByName(
        R.load_history(table(spark, d, "corpus_ds"), "corpus-id", "_id", "loaded_at", "deleted")
    )
    return refs, history


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of queries or records that weren't there at the time."""
    refs, history = _references(spark, d)
    return R.orphan_references(refs, history).select("qrel_no", "ref_field", "reason")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table and month."""
    refs, history = _references(spark, d)
    return R.orphan_report(refs, R.orphan_references(refs, history))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Passage ids of `qa_ds.relevant_passage_ids`, one in a row with its place."""
    return explode_packed(table(spark, d, "qa_ds"), "row_no", "relevant_passage_ids", "passage_id")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fields by the number of ids in them, those without any included."""
    qa = table(spark, d, "qa_ds").select("row_no")
    n = p3_found(spark, d).groupBy("row_no").agg(F.count("*").alias("n"))
    return qa.join(n, "row_no", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_ids")).agg(F.count("*").alias("n_fields"))


_P1 = """
WITH refs AS (
  SELECT qrel_no, 'query-id' AS ref_field, lower(regexp_replace("query-id", '^\\s+|\\s+$', '', 'g')) AS id, judged_at FROM qrels_ds
  UNION ALL
  SELECT qrel_no, 'corpus-id', lower(regexp_replace("corpus-id", '^\\s+|\\s+$', '', 'g')), judged_at FROM qrels_ds),
r AS (SELECT *, coalesce(judged_at, TIMESTAMP '9999-12-31 00:00:00') AS at_time FROM refs WHERE id IS NOT NULL AND id <> ''),
h AS (
  SELECT DISTINCT 'query-id' AS ref_field, lower(trim(_id)) AS id, loaded_at, deleted FROM queries_ds WHERE _id IS NOT NULL
  UNION SELECT DISTINCT 'corpus-id', lower(trim(_id)), loaded_at, deleted FROM corpus_ds WHERE _id IS NOT NULL),
j AS (
  SELECT r.qrel_no, r.ref_field, r.judged_at, count(h.id) AS n_rows, count(CASE WHEN h.loaded_at <= r.at_time THEN 1 END) AS n_before,
         arg_max(h.deleted, h.loaded_at) FILTER (WHERE h.loaded_at <= r.at_time) AS gone
  FROM r LEFT JOIN h ON r.ref_field = h.ref_field AND r.id = h.id GROUP BY 1, 2, 3),
o AS (SELECT qrel_no, ref_field, judged_at,
             CASE WHEN n_rows = 0 THEN 'missing' WHEN n_before = 0 THEN 'late' WHEN gone THEN 'deleted' END AS reason FROM j)
"""

_P3 = r"""
WITH u AS (
  SELECT row_no, CASE WHEN contains(relevant_passage_ids, '\"') OR contains(relevant_passage_ids, '\''')
    THEN regexp_replace(regexp_replace(relevant_passage_ids, '^\s*["'']|["'']\s*$', '', 'g'), '\\(["''])', '\1', 'g')
    ELSE relevant_passage_ids END AS x
  FROM qa_ds WHERE relevant_passage_ids IS NOT NULL),
p AS (SELECT row_no, unnest(string_split(replace(x, '''', '"'), '"')) AS piece, generate_subscripts(string_split(replace(x, '''', '"'), '"'), 1) AS k FROM u),
v AS (
  SELECT row_no, k, CASE WHEN k % 2 = 0 AND NOT regexp_matches(piece, '^\s*[\[({\])}<>]') THEN [piece]
    ELSE string_split_regex(piece, '[\s,;|/&、，；]+') END AS parts FROM p),
e AS (SELECT row_no, k, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM v),
t AS (SELECT row_no, k, n, regexp_replace(part, '^[\s\[\](){}<>.:]+|[\s\[\](){}<>.:]+$', '', 'g') AS passage_id FROM e),
f AS (
  SELECT row_no, CAST(row_number() OVER (PARTITION BY row_no ORDER BY k, n) AS INTEGER) AS pos, passage_id
  FROM t WHERE regexp_matches(passage_id, '[0-9]'))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_counts": p3_counts}

SQL = {
    "p1_found": _P1 + "SELECT qrel_no, ref_field, reason FROM o WHERE reason IS NOT NULL",
    "p1_report": _P1 + """
SELECT ref_field, strftime(judged_at, '%Y-%m') AS month, count(*) AS n_refs, count(reason) AS n_orphans,
       count(CASE WHEN reason = 'missing' THEN 1 END) AS n_missing, count(CASE WHEN reason = 'late' THEN 1 END) AS n_late,
       count(CASE WHEN reason = 'deleted' THEN 1 END) AS n_deleted
FROM o GROUP BY 1, 2""",
    "p3_found": _P3 + "SELECT row_no, pos, passage_id FROM f",
    "p3_counts": _P3 + """, n AS (SELECT row_no, count(*) AS n FROM f GROUP BY 1)
SELECT coalesce(n.n, 0) AS n_ids, count(*) AS n_fields FROM qa_ds LEFT JOIN n USING (row_no) GROUP BY 1""",
}
