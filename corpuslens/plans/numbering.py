"""Global numbers and ranks without a task that holds all rows: range partitions, and prefix sums of their sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.plans.lineage import cut


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_index(df: DataFrame, order: list, name: str = "_idx") -> DataFrame:
    """`df` with its rows' places, from 0, in the order of `order` (which should be a total order).

    The rows are range-partitioned and sorted, and written with their partition and place in it; the sizes of the
    partitions, one row each, are prefix-summed and broadcast.
    """
    mine = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(_partitions(df), *order).sortWithinPartitions(*order)
    written = cut(ordered.withColumn("_part", F.shiftright(mine, 33).cast("int")).withColumn("_in_part", mine.bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = written.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return written.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_in_part")).drop("_part", "_in_part", "_before")


def average_ranks(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, rank: for each distinct value of each key its rank from 1, ties sharing the mean of theirs.

    Equal values are counted first. A window holds the distinct values of one range partition, or one row for each
    partition of a key.
    """
    counts = values.groupBy(key, value).agg(F.count("*").alias("_n"))
    s = cut(counts.repartitionByRange(_partitions(values), key, value).withColumn("_part", F.spark_partition_id()))
    within = F.sum("_n").over(Window.partitionBy("_part", key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = s.groupBy("_part", key).agg(F.sum("_n").alias("_m")).select("_part", key, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    return s.withColumn("_upto", within).join(offsets, ["_part", key]).select(key, value, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("rank"))


def number_in_groups(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """`df` with the place, from 1, of each row within its group in the order of `order` (a total order within a group).

    One range-partitioned sort over all groups, so that a group of any size is spread over tasks. Each task numbers its
    rows as they stream by; groups that stand in several partitions, at most two for each partition, get the
    numbers of their rows before by a broadcast. Groups with null keys are groups, too.
    """
    ordered = df.repartitionByRange(_partitions(df), *keys, *order).sortWithinPartitions(*keys, *order)
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in df.dtypes), "_part int", "_place bigint"])
    written = cut(ordered.mapInArrow(_places(keys), schema))
    sizes = written.groupBy("_part", *keys).agg(F.max("_place").alias("_n"))
    several = sizes.groupBy(*keys).agg(F.collect_list(F.struct("_part", "_n")).alias("_in")).where(F.size("_in") > 1)
    before = F.aggregate("_in", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x["_part"] < F.col("_at._part"), x["_n"]).otherwise(0))
    offsets = several.withColumn("_at", F.explode("_in")).select(F.col("_at._part").alias("_part"), *[F.col(k).alias(f"_k_{k}") for k in keys], before.alias("_before"))
    same = F.col("_part") == F.col("_o_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = written.join(F.broadcast(offsets.withColumnRenamed("_part", "_o_part")), same, "left")
    return placed.select(*df.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(name))


def _places(keys: list[str]):
    """The rows of a sorted partition with its number and their place in their group there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                c = batch.column(k)
                differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
                gaps = c.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= differs | (gaps[1:] != gaps[:-1])
            first = [batch.column(k)[0].as_py() for k in keys]
            new[0] = first != last
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            places = np.arange(n) - starts + 1
            if not new[0]:
                places[: int(new.argmax()) if new.any() else n] += count
            last, count = [batch.column(k)[n - 1].as_py() for k in keys], int(places[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(places)], names=[*batch.schema.names, "_part", "_place"])

    return run
