"""What a retriever costs: building its index once, and its latency over a fixed set of queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame, SparkSession


def seconds(make: Callable[[], DataFrame]) -> float:
    """Wall time of making all rows of a DataFrame, without moving them anywhere."""
    began = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def efficiency(spark: SparkSession, retrievers: dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]], n_queries: int, repeats: int = 3) -> DataFrame:
    """retriever, index_s (1 decimal), latency_ms (1) and throughput (0, queries a second).

    `retrievers`: name to (what builds the index, what searches it for `n_queries` queries). The index is built once, and
    the search is timed apart from it, as the median of `repeats`.
    """
    rows = []
    for name, (build, search) in retrievers.items():
        index = seconds(build)
        latency = median(seconds(search) for _ in range(repeats)) * 1000 / max(1, n_queries)
        rows.append((name, round(index, 1), round(latency, 1), round(1000 / latency, 0)))
    return spark.createDataFrame(rows, "retriever string, index_s double, latency_ms double, throughput double")
