"""Question answering over retrieved evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import format_prompt, normalise_answer, prep_text


class Generator(Protocol):
    """Anything that answers a prompt with a text."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class EvidenceReader:
    """Answers with the evidence in its prompt, of which the first label counts: a model-free stand-in for a generator."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.split("Evidence:\n", 1)[1].rsplit("\nFinal answer:", 1)[0] for p in prompts]


def passages(questions: DataFrame, key: str, contexts: str) -> DataFrame:
    """doc_id, title, text: the passages of each question, with ids made of its key and their place from 0."""
    p = questions.select(F.col(key).cast("string").alias("k"), F.posexplode(contexts).alias("pos", "text"))
    return p.select(F.concat("k", F.lit("_p"), F.col("pos").cast("string")).alias("doc_id"), F.lit("").alias("title"), "text")


def contexts(queries: DataFrame, ranked: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """qid, text, passages: the texts of the k best documents of each query, in order; at most k for each query."""
    top = ranked.where(F.col("rank") <= k).join(corpus.select("doc_id", prep_text("title", "text").alias("passage")), "doc_id")
    gathered = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("p"))
    p = F.transform("p", lambda x: x["passage"])
    return queries.join(gathered, "qid", "left").select("qid", "text", F.coalesce(p, F.array().cast("array<string>")).alias("passages"))


def prompts(with_contexts: DataFrame) -> DataFrame:
    return with_contexts.select("qid", format_prompt(F.col("text"), F.col("passages")).alias("prompt"))


def generate(prompted: DataFrame, load: Callable[[], Generator]) -> DataFrame:
    """`prompted` with answer: the generator's text, brought to yes, no, maybe or unknown."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model.generate(list(b)), dtype="object")

    return prompted.withColumn("answer", normalise_answer(answer("prompt")))


def accuracy(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, n, accuracy (3 decimals) of answer against gold."""
    right = F.avg((F.col("answer") == F.col("gold")).cast("double"))
    return answers.groupBy(*by).agg(F.count("*").alias("n"), F.round(right, 3).alias("accuracy"))
