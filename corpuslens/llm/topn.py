"""The N best items of every group by one global sort, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.plans.lineage import cut


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; the first is False."""
    out = np.zeros(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _local_positions(group: list[str], item: str, largest: int):
    """For a sorted partition: the rows within their group's limit, with their positions among its rows here.

    A group's limit stands in a row of its own before its items (`_n` set). `known` rows have it in this partition, so
    that their positions are final. Without it, a partition's first group may go on from the one before: its rows are
    kept up to the largest limit and settled later; any other group has none and is dropped. A row without item
    (`n_here` set) follows for the group that the partition ends with, the only one that can go on in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, limit, seen, first_group, kinds = None, None, 0, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = [batch.schema.field(c).type for c in (*group, item)]
            new = np.zeros(n, bool)
            for g in group:
                new |= _changes(batch.column(g))
            here = tuple(batch.column(g)[0].as_py() for g in group)
            new[0] = here != last
            own = batch.column("_n").fill_null(-1).to_numpy().astype(np.int64)
            index = np.arange(n)
            start = np.maximum.accumulate(np.where(new, index, 0))
            limits = own[start]  # of a group that begins in this batch
            position = index - start + (limits < 0)
            carried = int(np.argmax(new)) if new.any() else n  # rows of the group that goes on from the last batch
            if carried and not new[0]:
                position[:carried] = seen + index[:carried] + 1
                limits[:carried] = -1 if limit is None else limit
            settled = limits >= 0
            if last is None:  # the partition's first group, without its limit
                until = int(np.argmax(new[1:])) + 1 if new[1:].any() else n
                open_ = ~settled & (index < until)
            elif first_group and not new[0]:
                open_ = ~settled & (index < carried)
            else:
                open_ = np.zeros(n, bool)
            keep = (own < 0) & (position <= np.where(settled, limits, np.where(open_, largest, -1)))
            kept = pa.RecordBatch.from_arrays([batch.column(c) for c in (*group, item)], names=[*group, item]).filter(pa.array(keep))
            yield _with(kept, part, position[keep], settled[keep])
            first_group = (first_group or last is None) and not new[1:].any() and (last is None or not new[0])
            last, seen = tuple(batch.column(g)[n - 1].as_py() for g in group), int(position[-1])
            limit = int(limits[-1]) if limits[-1] >= 0 else None
        if last is not None and (limit is not None or first_group):
            arrays = [*(pa.array([v], type=t) for v, t in zip((*last, None), kinds, strict=True))]
            yield _with(pa.RecordBatch.from_arrays(arrays, names=[*group, item]), part, None, None, seen, limit)

    def _with(batch: pa.RecordBatch, part: int, position, known, n_here: int | None = None, limit: int | None = None) -> pa.RecordBatch:
        n = batch.num_rows
        columns = [
            pa.array(np.full(n, part, np.int32)),
            pa.nulls(n, pa.int64()) if position is None else pa.array(position, pa.int64()),
            pa.nulls(n, pa.bool_()) if known is None else pa.array(known, pa.bool_()),
            pa.array([n_here] * n, pa.int64()),
            pa.array([limit] * n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*group, item, "_part", "_pos", "_known", "_here", "_limit"])

    return run


def top_n_per_group(
    items: DataFrame, group: list[str], item: str, score: str, limits: DataFrame, n: str, partitions: int | None = None
) -> DataFrame:
    """group, pos, item: the best `n` items of every group of `limits` (columns: group, `n`; one row for each group).

    Order: `score` downwards, ties by `item` upwards (strings by code point). An item that occurs more than once in
    a group counts once, with its highest score. Rows with a null group column, item or score, or a NaN score, don't
    count. Groups without a limit, or with a null one, give no rows; one with fewer items than `n` gives them all.

    One global range-partitioned sort on group, score and item, with each group's limit before its items, spreads even
    a group of a third of all rows over tasks. Each task numbers the rows of its groups and keeps those within the
    limit. Only groups that cross partitions need more: the numbers of rows that they have in each partition (one row
    for each partition at most, broadcast) are prefix-summed into exact positions. Nothing is shuffled after the sort.
    """
    spark = items.sparkSession
    wanted = limits.where(F.col(n).isNotNull())
    for g in group:
        wanted = wanted.where(F.col(g).isNotNull())
    wanted = cut(wanted.select(*group, F.col(n).cast("bigint").alias("_n")))
    largest = wanted.agg(F.max("_n")).first()[0]  # one number
    scored = items.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(item).isNotNull())
    for g in group:
        scored = scored.where(F.col(g).isNotNull())
    best = scored.groupBy(*group, item).agg(F.max(score).alias("_score"))
    marks = wanted.select(*group, F.lit(None).cast(dict(items.dtypes)[item]).alias(item), F.lit(None).cast(dict(best.dtypes)["_score"]).alias("_score"), "_n")
    every = best.withColumn("_n", F.lit(None).cast("bigint")).unionByName(marks)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(g).asc() for g in group], F.col("_score").desc_nulls_first(), F.col(item).asc()]
    ordered = every.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*group, item, "_n")
    types = dict(best.dtypes)
    names = ", ".join(f"`{c}` {types[c]}" for c in [*group, item])
    schema = f"{names}, _part int, _pos bigint, _known boolean, _here bigint, _limit bigint"
    local = cut(ordered.mapInArrow(_local_positions(group, item, int(largest or 0)), schema))
    known = local.where("_known").select(*group, F.col("_pos").alias("pos"), item)
    so_far = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    crossing = local.where("_here IS NOT NULL").select(
        *group, F.col("_part").alias("_from"), F.sum("_here").over(so_far).alias("_before"), F.max("_limit").over(so_far).alias("_most"),
        F.lead("_part").over(Window.partitionBy(*group).orderBy("_part")).alias("_to"),
    )
    behind = (F.col("_part") > F.col("_from")) & (F.col("_to").isNull() | (F.col("_part") <= F.col("_to")))
    settled = (
        local.where("NOT _known").join(F.broadcast(crossing), group).where(behind)
        .select(*group, (F.col("_pos") + F.col("_before")).alias("pos"), item, "_most").where("pos <= _most").drop("_most")
    )
    return known.unionByName(settled).select(*group, F.col("pos").cast("int").alias("pos"), item)


def group_limits(items: DataFrame, group: list[str], n: str, named: DataFrame, key: str) -> DataFrame:
    """group, n: the largest non-null `n` of each group whose `key` is named by `named`."""
    wanted = named.where(F.col(key).isNotNull()).select(key).distinct()
    per_group = items.groupBy(*group).agg(F.max(n).alias(n))
    return per_group.join(wanted, key, "left_semi").select(*group, n)
