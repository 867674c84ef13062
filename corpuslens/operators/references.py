"""References to records that do not exist: a distributed anti-join against what was alive at the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"
_LAST = "TIMESTAMP_NTZ'9999-12-31 23:59:59'"


def clean_id(col: str | Column) -> Column:
    """Ids compare without white space at their ends and without regard to case; an empty one is null."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(c != "", c)


def load_history(parent: DataFrame, ref_field: str, key: str, at: str, gone: str) -> DataFrame:
    """ref_field, id, at, gone: one row for each id and load time. A null load time counts as the earliest."""
    rows = parent.select(
        clean_id(F.col(f"`{key}`")).alias("id"),
        F.coalesce(F.col(at).cast("timestamp_ntz"), F.expr(_FIRST)).alias("at"),
        F.coalesce(F.col(gone), F.lit(False)).alias("gone"),
    )
    return rows.where(F.col("id").isNotNull()).groupBy(F.lit(ref_field).alias("ref_field"), "id", "at").agg(F.min("gone").alias("gone"))


def alive_spans(history: DataFrame) -> DataFrame:
    """ref_field, id, since, until: the spans of time in which an id was present.

    The previous state of a row is looked up in two steps, within its day and then among the ids' last states
    of earlier days, so that no window holds all rows of a hot id: one has the rows of an id's day, the other a
    row for each day of an id, the last only the changes of state.
    """
    h = history.withColumn("day", F.to_date("at"))
    of_day = h.groupBy("ref_field", "id", "day").agg(F.max_by("gone", "at").alias("day_end"))
    before = of_day.select(
        "ref_field", "id", "day",
        F.lag("day_end").over(Window.partitionBy("ref_field", "id").orderBy("day")).alias("before_day"),
    )
    within = F.lag("gone").over(Window.partitionBy("ref_field", "id", "day").orderBy("at"))
    states = h.withColumn("previous", within).join(before, ["ref_field", "id", "day"])
    was_gone = F.coalesce("previous", "before_day", F.lit(True))
    changes = states.where(F.col("gone") != was_gone)
    following = F.lead("at").over(Window.partitionBy("ref_field", "id").orderBy("at"))
    return (
        changes.select("ref_field", "id", "gone", F.col("at").alias("since"), following.alias("until"))
        .where(~F.col("gone"))
        .select("ref_field", "id", "since", F.coalesce("until", F.expr("TIMESTAMP_NTZ'9999-12-31 23:59:59.999999'")).alias("until"))
    )


def unpivot_references(child: DataFrame, row_key: str, ref_fields: list[str], at: str) -> DataFrame:
    """One row for each non-empty reference of each row: row_key, ref_field, id, at (null: the end of time)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), clean_id(F.col(f"`{f}`")).alias("id")) for f in ref_fields]))
    refs = child.select(F.col(row_key), F.col(at).cast("timestamp_ntz").alias("judged_at"), each.alias("ref"))
    return refs.select(
        row_key, F.col("ref.ref_field").alias("ref_field"), F.col("ref.id").alias("id"), "judged_at",
        F.coalesce("judged_at", F.expr(_LAST)).alias("at"),
    ).where(F.col("id").isNotNull())


def orphan_references(references: DataFrame, history: DataFrame) -> DataFrame:
    """The references whose id wasn't alive at their time, with a reason.

    The distinct keys (field, id, time) of the references are anti-joined with the spans in which the ids were
    alive; what is left gets its reason from the ids' first load (`missing`: none at all, `late`: only after the
    reference's time, `deleted`: otherwise) and is joined back to the references. A hot id is spread over tasks:
    the distinct keys and the join back are partitioned by id and time, and only the anti-join by id, whose
    many-row side adaptive execution splits. Repeated rows stay repeated, as each has its own row key.
    """
    keys = references.select("ref_field", "id", "at").distinct()
    spans = alive_spans(history)
    k, s = keys.alias("k"), spans.alias("s")
    dangling = k.join(
        s,
        (F.col("k.ref_field") == F.col("s.ref_field")) & (F.col("k.id") == F.col("s.id"))
        & (F.col("k.at") >= F.col("s.since")) & (F.col("k.at") < F.col("s.until")),
        "left_anti",
    )
    first = history.groupBy("ref_field", "id").agg(F.min("at").alias("first_at"))
    reasoned = dangling.join(first, ["ref_field", "id"], "left").select(
        "ref_field", "id", "at",
        F.when(F.col("first_at").isNull(), "missing").when(F.col("first_at") > F.col("at"), "late").otherwise("deleted").alias("reason"),
    )
    return references.join(reasoned, ["ref_field", "id", "at"])


def orphan_report(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table (field) and month of the reference: how many references there are and how many are orphans, by reason."""
    month = F.date_format("judged_at", "yyyy-MM").alias("month")
    n = references.groupBy("ref_field", month).agg(F.count("*").alias("n_refs"))
    by_reason = orphans.groupBy("ref_field", month).agg(
        F.count("*").alias("n_orphans"),
        *[F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}") for r in ("missing", "late", "deleted")],
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_orphans", "n_missing", "n_late", "n_deleted")]
    same = (n["ref_field"] == by_reason["ref_field"]) & n["month"].eqNullSafe(by_reason["month"])
    return n.join(by_reason, same, "left").select(n["ref_field"], n["month"], "n_refs", *counts)
