"""Writing reports and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, decimals: int | None = 4) -> None:
    """A small table as one CSV file with a header, its doubles rounded."""
    rounded = df if decimals is None else df.withColumns({c: F.round(c, decimals) for c, t in df.dtypes if t in ("double", "float")})
    rounded.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_collection(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, path: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> None:
    """A collection in the layout that `collections.load_collection` reads: corpus (doc_id, title, text) and queries (qid, text)
    as JSON lines, the judgements (qid, doc_id, rel, split) of each split as a table with tabs. Each is a folder of parts."""
    corpus.select(F.col("doc_id").alias("_id"), "title", "text").write.json(f"{path}/corpus.jsonl")
    queries.select(F.col("qid").alias("_id"), "text").write.json(f"{path}/queries.jsonl")
    judged = qrels.select("split", F.col("qid").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("rel").alias("score"))
    for s in splits:
        out = judged.where(F.col("split") == s).drop("split").write.option("header", True)
        out.csv(f"{path}/qrels/{s}.tsv", sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def per_query_wide(per_query: DataFrame, methods: list[str], value: str = "ndcg") -> DataFrame:
    """qid and a column for each method."""
    return per_query.groupBy("qid").pivot("method", methods).agg(F.first(value))


def backfill(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`table` with the columns of `new` put in where the key matches; null new values leave the old."""
    cols = [c for c in new.columns if c != key]
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = table.join(fresh, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns])


def rewrite(df: DataFrame, path: str) -> None:
    """Write next to `path` and swap, as a table cannot overwrite the files that it is read from."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, fresh, old = (hadoop.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"))
    df.write.parquet(fresh.toString())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)
