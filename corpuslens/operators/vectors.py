"""Dense and sparse vector retrieval, with encoders plugged in behind pandas UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.metrics import rank_run


class Encoder(Protocol):
    """Anything that turns texts into an array of vectors, one row each."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encode(df: DataFrame, text: str, load: Callable[[], Encoder], prefix: str = "") -> DataFrame:
    """`df` with embedding, of unit length. `load` is called once in each Python worker's stream of batches."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            v = np.asarray(model.encode([prefix + (t or "") for t in texts]), dtype="float32")
            norms = np.linalg.norm(v, axis=1, keepdims=True) if len(v) else np.ones((0, 1))
            yield pd.Series(list(v / np.where(norms > 0, norms, 1)))

    return df.withColumn("embedding", vectors(F.col(text)))


class HashingEncoder:
    """Counts of words hashed to `dim` places: a model-free encoder for tests and small machines. With `damped`, log(1 + count)."""

    def __init__(self, dim: int = 64, damped: bool = False):
        self.dim, self.damped = dim, damped

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim), "float32")
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.dim] += 1
        return np.log1p(out) if self.damped else out


#: Query vectors that are broadcast (of a few hundred dimensions: some tens of MB); more are joined in blocks.
SENT = 20_000
#: Query and document vectors that meet in one group, and query vectors multiplied at once.
QUERY_BLOCK, DOC_BLOCK, TILE = 4096, 8192, 512


def dense_top_k(docs: DataFrame, queries: DataFrame, k: int = 100, sent: int = SENT, query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """qid, doc_id, score, rank: the k documents of the largest inner product with each query. Ids are strings or numbers.

    The stated query set meets all documents, which are read once. Up to `sent` queries are broadcast and the documents
    stay where they are; beyond, blocks of queries and of documents, numbered by hashes of their ids, are joined by these
    numbers, and no vector passes through the driver. Either way k rows for each query and block of documents are shuffled
    to the end. Null vectors, and those of another width than most queries, are left out.
    """
    named = queries.select("qid", "embedding").where("qid IS NOT NULL AND embedding IS NOT NULL")
    widths = named.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    kinds = dict(docs.dtypes)["doc_id"], dict(queries.dtypes)["qid"]
    schema = f"qid {kinds[1]}, doc_id {kinds[0]}, score double"
    if widths is None:
        return rank_run(docs.sparkSession.createDataFrame([], schema), ["qid"], k)
    dim = widths["dim"]
    asked = named.where(F.size("embedding") == dim)
    against = docs.select("doc_id", "embedding").where(F.col("doc_id").isNotNull() & (F.size("embedding") == dim))
    if widths["count"] <= sent:
        own = asked.collect()  # at most `sent` rows
        shared = docs.sparkSession.sparkContext.broadcast((pa.array([r["qid"] for r in own]), np.array([r["embedding"] for r in own], dtype="float64")))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors = shared.value
            for batch in batches:
                if batch.num_rows:
                    yield from _best(names, vectors, batch.column("doc_id"), _matrix(batch.column("embedding"), dim), k)

        return rank_run(against.mapInArrow(local, schema), ["qid"], k)
    q_blocks, d_blocks = -(-widths["count"] // query_block), -(-against.count() // doc_block)
    own = F.pmod(F.xxhash64("qid"), F.lit(q_blocks))
    q = asked.select("qid", F.col("embedding").alias("asked")).withColumns({"qb": own, "db": F.explode(F.sequence(F.lit(0), F.lit(max(0, d_blocks - 1))))})
    d = against.select("doc_id", F.col("embedding").alias("given")).withColumns({"db": F.pmod(F.xxhash64("doc_id"), F.lit(max(1, d_blocks))), "qb": F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))})

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        parts = []
        if x.num_rows and y.num_rows:
            names, ids = (t.column(c).combine_chunks() for t, c in ((x, "qid"), (y, "doc_id")))
            vectors, m = (_matrix(t.column(c).combine_chunks(), dim) for t, c in ((x, "asked"), (y, "given")))
            parts = list(_best(names, vectors, ids, m, k))
        return pa.Table.from_batches(parts) if parts else pa.table({"qid": x.column("qid").slice(0, 0), "doc_id": y.column("doc_id").slice(0, 0), "score": pa.array([], pa.float64())})

    return rank_run(q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(met, schema), ["qid"], k)


def _matrix(rows: pa.Array, dim: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("float64")


def _best(names: pa.Array, vectors: np.ndarray, ids: pa.Array, m: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of some documents for each query; ties at the edge stay, so that the final order by id is exact."""
    for at in range(0, len(names), TILE):
        scores = vectors[at : at + TILE] @ m.T
        edge = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
        i, j = np.nonzero(np.round(scores, 6) >= np.round(edge, 6)[:, None])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i + at)), ids.take(pa.array(j)), pa.array(scores[i, j])], names=["qid", "doc_id", "score"])


class SparseEncoder(Protocol):
    """Anything that gives each text its (term, logit) pairs, one for each position and term."""

    def encode(self, texts: list[str]) -> list[list[tuple[int, float]]]: ...


def encode_sparse(df: DataFrame, key: str, text: str, load: Callable[[], SparseEncoder]) -> DataFrame:
    """key, term, logit, mask for `sparse_pool`; positions that a model masks out are not to be returned by it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            found = model.encode([t or "" for t in b[text]])
            flat = [(k, int(t), float(x), 1.0) for k, own in zip(b[key], found, strict=True) for t, x in own]
            yield pd.DataFrame(flat, columns=[key, "term", "logit", "mask"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(rows, f"`{key}` {kind}, term bigint, logit double, mask double")


def sparse_pool(weights: DataFrame, key: str) -> DataFrame:
    """key, term, weight: a text's term weight is the largest over its positions of log(1 + max(0, logit)), where the
    mask is set. `weights` has key, term, logit, mask; terms of weight 0 are left out."""
    w = F.log1p(F.greatest(F.col("logit"), F.lit(0.0))) * F.col("mask")
    return weights.groupBy(key, "term").agg(F.max(w).alias("weight")).where("weight > 0")


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """qid, doc_id, score, rank by the product of sparse vectors (doc_id, term, weight) and (qid, term, weight)."""
    q = queries.select("qid", "term", F.col("weight").alias("w"))
    scores = docs.join(q, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    return rank_run(scores, ["qid"], k)
