"""Reranking candidates by a scorer of (query, document) pairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import prep_text, word_tokens
from corpuslens.operators.metrics import rank_run


class PairScorer(Protocol):
    """Anything that gives each (query, text) pair a score."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def model_score(load: Callable[[], PairScorer]) -> Callable[[Column, Column], Column]:
    """A scoring expression that calls a model, loaded once in each Python worker's stream of batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield pd.Series([float(x) for x in model.predict(list(zip(q.fillna(""), t.fillna(""), strict=True)))], dtype="float64")

    return score


class OverlapScorer:
    """The share of the query's words that the text has, as a scorer of pairs: a model-free stand-in for learned ones."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9\-]+", t)}
        sets = [(words(q), words(t)) for q, t in pairs]
        return [len(q & t) / len(q) if q else 0.0 for q, t in sets]


def lexical_score(query: Column, text: Column) -> Column:
    """The model-free scorer: the share of the query's words that the text has."""
    q, t = F.array_distinct(word_tokens(query)), F.array_distinct(word_tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, score: Callable[[Column, Column], Column] = lexical_score, k: int | None = None) -> DataFrame:
    """qid, doc_id, score, rank of all candidates (qid, doc_id) in the scorer's order; with `k`, the first k of them.

    A query should have some hundreds of candidates at most, as a scorer's time goes with their number.
    Candidates without a document are an error of the run: see `missing_candidates`; here they are left out.
    """
    texts = corpus.select("doc_id", prep_text("title", "text").alias("doc_text"))
    pairs = candidates.select("qid", "doc_id").join(queries.select("qid", F.col("text").alias("query")), "qid").join(texts, "doc_id")
    return rank_run(pairs.select("qid", "doc_id", score(F.col("query"), F.col("doc_text")).alias("score")), ["qid"], k, few=True)


def missing_candidates(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    return candidates.join(corpus.select("doc_id"), "doc_id", "left_anti")
