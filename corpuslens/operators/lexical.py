"""BM25 over postings of blocks of documents, with the statistics of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import prep_text, retrieval_tokens
from corpuslens.operators.metrics import rank_run
from corpuslens.plans.lineage import cut, discard

#: (query, term) rows that the driver and each task hold at once; more queries are answered in turns.
SENT = 200_000
#: Documents scored at once; a term in one of DENSE of them or more is added as a whole vector, up to VECTORS terms.
DOCS, DENSE, VECTORS = 32_768, 8, 200
#: One document of PROBED, in PROBES tasks, gives a lower bound of each query's k-th score.
PROBED, PROBES = 8, 16
#: Rows put out at once.
ROWS = 50_000


def token_table(corpus: DataFrame) -> DataFrame:
    """doc_id, tokens, dl: the corpus in tokens. Documents without tokens have length 0 and count."""
    tokens = corpus.select("doc_id", retrieval_tokens(prep_text("title", "text")).alias("tokens"))
    return tokens.select("doc_id", "tokens", F.size("tokens").alias("dl"))


def postings(tokens: DataFrame) -> DataFrame:
    """doc_id, dl, term, tf."""
    return tokens.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def index_stats(tokens: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(df: term, df; one row of n_docs, avgdl)."""
    return terms.groupBy("term").agg(F.count("*").alias("df")), tokens.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, qtf: a repeated word counts again."""
    t = queries.select("qid", F.explode(retrieval_tokens(F.col("text"))).alias("term"))
    return t.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25(
    corpus: DataFrame, queries: DataFrame, k: int = 100, k1: float = 1.5, b: float = 0.75, pad: bool = False, sent: int = SENT, docs: int = DOCS
) -> DataFrame:
    """qid, doc_id, score, rank: the k best documents of each query.

    The corpus is read once: of each document its length and the counts of those of its words that a query names are
    written. Each task scores its documents, `docs` at a time, for every query, so that no matches of a query but its best
    leave a task. What a document needs to be among the k is bounded from below first: the k-th score among some of the
    documents is no more than that among all. More than `sent` rows of (query, term) are taken in turns. `pad` fills a
    query's list up to k documents with others of score 0, in the order of their ids, as a dense score matrix would.
    """
    wanted = cut(query_terms(queries))
    turns = max(1, -(-wanted.count() // sent))
    tokens = token_table(corpus)
    if turns == 1:
        packed, scores = _scores(tokens, wanted, k, k1, b, docs)
        top, ids = rank_run(scores, ["qid"], k), packed
    else:
        tokens, parts = cut(tokens), []
        for turn in range(turns):
            packed, scores = _scores(tokens, wanted.where(F.pmod(F.xxhash64("qid"), F.lit(turns)) == turn), k, k1, b, docs)
            parts.append(cut(rank_run(scores, ["qid"], k)))
            discard(packed)
        top, ids = reduce(DataFrame.unionByName, parts), tokens
    return _padded(top, ids.select("doc_id"), queries, k) if pad else top


@dataclass
class _Asked:
    """Queries as they are sent to the tasks; the terms of query q are those from starts[q] on."""

    qids: pa.Array
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    n_terms: int
    scale: tuple[float, float]  # a count's norm is the first plus the second times the document's length
    least: np.ndarray  # scores at or below it are not among the k best


def _scores(tokens: DataFrame, wanted: DataFrame, k: int, k1: float, b: float, docs: int) -> tuple[DataFrame, DataFrame]:
    """(packed documents, the rows qid, doc_id, score that may be among the k best of a query)."""
    sc = tokens.sparkSession.sparkContext
    rows = wanted.select("qid", "term", "qtf").collect()  # bounded by `sent`
    qids, named = ({x: i for i, x in enumerate(dict.fromkeys(r[c] for r in rows))} for c in ("qid", "term"))
    kinds = dict(wanted.dtypes)["qid"], dict(tokens.dtypes)["doc_id"]
    packed = cut(tokens.mapInArrow(_pack(sc.broadcast(pa.array(list(named), pa.string()))), f"doc_id {kinds[1]}, dl int, packed binary"))
    counts = packed.select("dl", "packed").mapInArrow(_tally(len(named)), "term int, n bigint").groupBy("term").agg(F.sum("n")).collect()
    totals = {t: n for t, n in counts}
    n = totals.pop(-1, 0)
    avgdl = totals.pop(-2, 0) / max(1, n) or 1.0
    df = np.zeros(len(named))
    df[list(totals)] = list(totals.values())
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    q, t = (np.array([of[r[c]] for r in rows], np.int64) for c, of in (("qid", qids), ("term", named)))
    order = np.lexsort((t, q))
    weights = (np.array([r["qtf"] for r in rows], np.float64) * idf[t])[order]
    names = pa.array(list(qids), pa.int64() if kinds[0] == "bigint" else None)
    asked = _Asked(names, np.searchsorted(q[order], np.arange(len(qids) + 1)), t[order], weights, len(named), (k1 * (1.0 - b), k1 * b / avgdl), np.zeros(len(qids)))
    some = packed.where(F.pmod(F.xxhash64("doc_id"), F.lit(PROBED)) == 0).repartition(PROBES)
    best = some.mapInArrow(_probe(sc.broadcast(asked), -(-2 * k // PROBES), docs), "q int, scores array<double>")
    best = best.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("scores")), asc=False).alias("s")).where(F.size("s") >= k)
    for r in best.select("q", F.element_at("s", k)).collect():
        asked.least[r[0]] = max(0.0, r[1] - 2e-6)  # ranks go by 6 decimals
    return packed, packed.mapInArrow(_top(sc.broadcast(asked), k, docs), f"qid {kinds[0]}, doc_id {kinds[1]}, score double")


def _pack(named):
    """doc_id, dl, packed: pairs of a named term's number and its count, each in 4 bytes; of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            flat = tokens.flatten()
            term = pc.fill_null(pc.index_in(flat, value_set=named.value.cast(flat.type)), -1).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(tokens).to_numpy())
            place, times = np.unique((doc << 32 | term)[term >= 0], return_counts=True)
            pairs = np.stack([place & 0xFFFFFFFF, times], axis=1).astype("<u4")
            ends = (8 * np.searchsorted(place >> 32, np.arange(batch.num_rows + 1))).astype("<i4")
            out = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(pairs.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dl"), out], names=["doc_id", "dl", "packed"])

    return run


def _pairs(packed: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<u4").reshape(-1, 2)


def _tally(n_terms: int):
    """term, n: documents that have the term; at -1 all documents, at -2 their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_pairs(batch.column("packed"))[:, 0], minlength=n_terms)
            n, length = n + batch.num_rows, length + (pc.sum(batch.column("dl")).as_py() or 0)
        there = np.flatnonzero(df)
        terms, values = np.append(there, [-1, -2]), np.append(df[there], [n, length])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(values, pa.int64())], names=["term", "n"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[pa.Table]:
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        for k in range(0, batch.num_rows, docs):
            waiting.append(batch.slice(k, docs))
            if sum(w.num_rows for w in waiting) >= docs:
                yield pa.Table.from_batches(waiting)
                waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting)


def _scored(rows: pa.Table, asked: _Asked) -> Iterator[tuple[int, np.ndarray]]:
    """(query, its scores of all rows) of each query that has a match; the array is used again for the next."""
    n, pairs = rows.num_rows, _pairs(rows.column("packed"))
    order = np.argsort(pairs[:, 0], kind="stable")
    doc = np.repeat(np.arange(n), pc.binary_length(rows.column("packed")).to_numpy() // 8)[order]
    times = pairs[order, 1].astype(np.float64)
    part = times / (times + (asked.scale[0] + asked.scale[1] * rows.column("dl").to_numpy())[doc])
    ends = np.append(0, np.cumsum(np.bincount(pairs[:, 0], minlength=asked.n_terms))).tolist()
    starts, terms, weights = asked.starts.tolist(), asked.terms.tolist(), asked.weights.tolist()
    vectors: dict[int, np.ndarray] = {}
    scores, weighted = np.empty(n), np.empty(n)
    for q in range(len(starts) - 1):
        own = [(t, w) for t, w in zip(terms[starts[q] : starts[q + 1]], weights[starts[q] : starts[q + 1]], strict=True) if ends[t] < ends[t + 1]]
        if not own:
            continue
        scores.fill(0.0)
        for t, w in own:
            lo, hi = ends[t], ends[t + 1]
            if (hi - lo) * DENSE >= n and t not in vectors and len(vectors) < VECTORS:
                vectors[t] = np.zeros(n)
                vectors[t][doc[lo:hi]] = part[lo:hi]
            if t in vectors:
                scores += np.multiply(vectors[t], w, out=weighted)
            else:
                scores[doc[lo:hi]] += w * part[lo:hi]
        yield q, scores


def _probe(asked, most: int, docs: int):
    """q, scores: the `most` best scores of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(asked.value.qids), most))  # ascending
        for rows in _blocks(batches, docs):
            for q, scores in _scored(rows, asked.value):
                better = scores[scores > best[q, 0]]
                if len(better):
                    best[q] = np.sort(np.partition(np.append(best[q], better), -most)[-most:])
        there = np.flatnonzero(best[:, -1] > 0)
        ends = np.append(0, np.cumsum((best[there] > 0).sum(axis=1)))
        scores = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(best[there][best[there] > 0]))
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), scores], names=["q", "scores"])

    return run


def _top(asked, k: int, docs: int):
    """qid, doc_id, score: of each block of documents, the k best of each query among those above its least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = asked.value
        for rows in _blocks(batches, docs):
            rows = rows.take(pc.sort_indices(rows.column("doc_id")))  # so that of equal scores the first ids stay
            ids = rows.column("doc_id").combine_chunks()
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            n = 0
            for q, scores in _scored(rows, of):
                there = np.flatnonzero(scores > of.least[q])
                if len(there) > k:
                    there = there[_first(np.floor(scores[there] * 1e6 + 0.5), k)]
                if len(there):
                    found.append((q, there, scores[there]))
                    n += len(there)
                if n >= ROWS:
                    yield batch(of, ids, found)
                    found, n = [], 0
            if found:
                yield batch(of, ids, found)

    def batch(of: _Asked, ids: pa.Array, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        q = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        doc, scores = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([of.qids.take(pa.array(q)), ids.take(pa.array(doc)), pa.array(scores)], names=["qid", "doc_id", "score"])

    return run


def _first(values: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest; of equal ones the first."""
    near = np.flatnonzero(values >= np.partition(values, -k)[-k])
    return near[np.argsort(-values[near], kind="stable")[:k]]


def _padded(top: DataFrame, ids: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first 2k documents by id hold at least k that are not among a query's own."""
    top = cut(top)  # read twice
    first = ids.orderBy("doc_id").limit(2 * k).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    own = queries.select("qid").join(top.groupBy("qid").agg(F.collect_list("doc_id").alias("own")), "qid", "left")
    rest = own.join(F.broadcast(first)).select("qid", "own", F.array_except("ids", F.coalesce("own", F.array().cast("array<string>"))).alias("rest"))
    more = rest.select("qid", F.explode(F.slice("rest", 1, F.greatest(F.lit(0), F.lit(k) - F.coalesce(F.size("own"), F.lit(0))))).alias("doc_id"))
    filled = top.select("qid", "doc_id", "score").unionByName(more.withColumn("score", F.lit(0.0)))
    return rank_run(filled, ["qid"], k)
