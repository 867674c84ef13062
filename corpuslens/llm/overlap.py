"""Same or near-same texts across splits, by a suffix array over all texts.

A text is reduced to its distinct words in one global order, rare words first (words in at least `common_share` of all
texts come last, by their counts; the others are ordered by their hash): two texts that differ in spelling, order or some
words are then two sequences with long runs in common. All these sequences stand one after the other, and their suffixes
are sorted globally: range partitions, each sorted, with what a suffix has in common with the one before it, and the
edges of the partitions exchanged. Neighbours with a common prefix make an interval; within it, suffixes of
different splits share a span.

Two sets of a and b words that share at least the part t of their union have their first common word among the first
a - ceil(t * a) + 1 words of the one and the first b - ceil(t * b) + 1 of the other, so only suffixes that start there
are needed to meet each such pair. What their sorted words can share from there on bounds the pairs; those left are
compared over their whole sets. Merged over all common spans, the words covered are the shared ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.plans.lineage import cut
from corpuslens.plans.sizes import small_side

#: Words by which suffixes are sorted. Suffixes that agree in all of them stand in one interval in any order, and what lies
#: beyond them counts as shared until the whole sets are compared.
SORTED_WORDS = 8
#: Common words come after rare ones, whose numbers are their hashes.
COMMON = 2**62
#: Suffixes of a split in an interval that meet those of another split in one task; larger intervals are split into blocks.
BLOCK = 2048


#: Maps that the common words are spread over, as a lookup goes through the whole of a map.
MAPS = 1024


def words(text: Column) -> Column:
    """The distinct words (longest runs of letters and digits) of the lower-cased text, in order of their letters."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def _common(texts: DataFrame, common_share: float) -> DataFrame:
    """One row, ranks: the words in at least `common_share` of all texts with their places in the order of their counts,
    as maps by the word's hash.

    There are at most (mean number of words) / common_share of them, however many texts there are, so they are
    broadcast; the counts are over all texts.
    """
    n = texts.agg(F.count("*")).first()[0]
    counts = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, common_share * n))
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for i, r in enumerate(sorted(counts.select("word", "n", _map_of(F.col("word")).alias("at")).collect(), key=lambda r: (r["n"], r["word"]))):
        maps[r["at"]][r["word"]] = i
    return texts.sparkSession.createDataFrame([(maps,)], "ranks array<map<string,bigint>>")


def _map_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(MAPS)).cast("int")


def in_order(sets: DataFrame, common: DataFrame) -> DataFrame:
    """`sets` with numbers: those of their words, ascending. Rare words stand first, by their hashes."""
    rank = lambda x: F.try_element_at(F.get("ranks", _map_of(x)), x)
    number = lambda x: F.coalesce(rank(x) + F.lit(COMMON), F.xxhash64(x).bitwiseAND(F.lit(COMMON - 1)))
    return sets.crossJoin(F.broadcast(common)).withColumn("numbers", F.sort_array(F.transform("words", number))).drop("ranks")


def suffixes(sets: DataFrame, similarity: float) -> DataFrame:
    """set_id, size, start, suffix (the first SORTED_WORDS numbers) of the suffixes that are needed to meet every pair."""
    size = F.size("numbers")
    starts = F.sequence(F.lit(0), size - F.ceil(F.lit(similarity) * size - F.lit(1e-9)).cast("int"))
    s = sets.select("set_id", "in_train", "in_eval", size.alias("size"), "numbers", F.explode(starts).alias("start"))
    return s.select("set_id", "in_train", "in_eval", "size", "start", F.slice("numbers", F.col("start") + 1, SORTED_WORDS).alias("suffix"))


def suffix_array(needed: DataFrame, span: int = 1) -> DataFrame:
    """`needed` in the order of its suffixes, with interval: the same number for neighbours, and all between them, whose
    common prefixes have `span` words.

    Written once sorted. The common prefix with the suffix before is taken within each partition; whether the first interval of a
    partition goes on from the one before is told by the edges of the partitions, one row for each.
    """
    spark = needed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([*(f"{c} {kind}" for c, kind in needed.dtypes), "part int", "interval bigint"])
    ordered = needed.repartitionByRange(parts, "suffix", "set_id").sortWithinPartitions("suffix", "set_id")
    array = cut(ordered.mapInArrow(_intervals(span), schema))
    prefix = F.slice("suffix", 1, span)
    edges = array.groupBy("part").agg(
        F.min("interval").alias("first"), F.max("interval").alias("last"),
        F.min_by(prefix, "interval").alias("first_prefix"), F.max_by(prefix, "interval").alias("last_prefix"),
    )
    joined, last, name = [], None, {}
    for e in sorted(edges.collect(), key=lambda e: e["part"]):  # one row for each partition
        own = (e["part"], e["first"])
        if last is not None and len(e["first_prefix"]) == span and e["first_prefix"] == last[1]:
            name[own] = name.get(last[0], last[0])
            joined.append((*own, *name[own]))
        last = (e["part"], e["last"]), e["last_prefix"]
    goes_on = F.broadcast(spark.createDataFrame(joined, "part int, interval bigint, to_part int, to_interval bigint"))
    return array.join(goes_on, ["part", "interval"], "left").withColumns({"part": F.coalesce("to_part", "part"), "interval": F.coalesce("to_interval", "interval")}).drop("to_part", "to_interval")


def _intervals(span: int):
    """The rows of a sorted partition with its number and that of their interval in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, interval, before = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("suffix")
            sizes = np.minimum(lists.value_lengths().to_numpy(), span)
            flat, starts = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy()
            prefix = np.full((batch.num_rows, span), -1, np.int64)  # what is missing in a short suffix is no word
            for k in range(span):
                prefix[sizes > k, k] = flat[starts[sizes > k] + k]
            above = np.vstack([before if before is not None else np.full((1, span), -1, np.int64), prefix[:-1]])
            common = np.minimum.accumulate((prefix == above) & (prefix >= 0), axis=1).sum(axis=1)
            numbers = interval + np.cumsum(common < span)
            interval, before = int(numbers[-1]), prefix[-1:]
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "interval"])

    return run


def shared_spans(array: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """x, y: pairs of an eval set and a train set in one interval that can share enough words from there on.

    Where the first word that two sets have in common leads their suffixes, all their common words are in these: at
    most as many as the shorter has, and as the sorted words share with what lies beyond them added. An interval of
    any size is spread over tasks: each block of its eval suffixes meets each block of its train suffixes on its own.
    """
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("set_id", "size", "start", "suffix")]
    blocks = lambda c: F.ceil(F.count(F.when(F.col(c), 1)) / block).alias(f"{c}_blocks")
    counted = array.groupBy("part", "interval").agg(blocks("in_eval"), blocks("in_train"))
    large = small_side(cut(counted.where("in_eval_blocks > 0 AND in_train_blocks > 0 AND in_eval_blocks + in_train_blocks > 2")))
    spread = array.join(large, ["part", "interval"], "left")
    own = lambda c: F.coalesce(F.pmod(F.xxhash64("set_id"), F.col(f"{c}_blocks")), F.lit(0))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{c}_blocks"), F.lit(1)) - 1))
    a = spread.where("in_eval").select("part", "interval", own("in_eval").alias("i"), every("in_train").alias("j"), *side("x"))
    b = spread.where("in_train").select("part", "interval", every("in_eval").alias("i"), own("in_train").alias("j"), *side("y"))
    enough = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size_x") + F.col("size_y")) - F.lit(1e-9))
    ahead = F.least(F.col("size_x") - F.col("start_x"), F.col("size_y") - F.col("start_y"))
    beyond = [F.greatest(F.col(f"size_{c}") - F.col(f"start_{c}") - SORTED_WORDS, F.lit(0)) for c in "xy"]
    shared = F.size(F.array_intersect("suffix_x", "suffix_y")) + beyond[0] + beyond[1]
    met = a.join(b, ["part", "interval", "i", "j"]).where((ahead >= enough) & (shared >= enough))
    return met.select(F.col("set_id_x").alias("x"), F.col("set_id_y").alias("y")).distinct()


def split_overlaps(roster: DataFrame, texts: DataFrame, evals: list[str], train: str, similarity: float, common_share: float = 0.002) -> DataFrame:
    """eval_split, eval_qid, qid_a, qid_b, similarity, covered: overlaps of the eval splits with train; covered is the
    number of words in common spans, over whole texts.

    `roster`: split, qid (a record may be in several splits); `texts`: qid, text. A pair is one record in both splits,
    or two whose sets of words share at least `similarity` of their union; the smaller id stands first, and
    rows are distinct: two records that both stand in an eval split and in train are an overlap of either of them. Records
    without any word, without text or with null ids or splits are no cases. Equal sets of words are compared once,
    whatever their number of records; the records come in again at the end. Sets of one template, whose rarest word is the
    same, fill one interval, which is compared in blocks.
    """
    r = roster.where(F.col("split").isin(*evals, train) & F.col("qid").isNotNull()).groupBy("qid").agg(F.collect_set("split").alias("splits"))
    t = texts.where(F.col("qid").isNotNull() & F.col("text").isNotNull()).select("qid", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    key = {"k": F.xxhash64("words"), "l": F.xxhash64(F.lit(1), "words")}  # 128 bits stand for a set of words
    records = cut(t.join(r, "qid").withColumns(key))
    of_split = [F.max(F.exists("splits", lambda x: x == train)).alias("in_train"), F.max(F.exists("splits", lambda x: x != train)).alias("in_eval")]
    one = records.groupBy("k", "l").agg(F.first("words").alias("words"), *of_split)
    sets = cut(in_order(one, _common(records, common_share)).withColumn("set_id", F.monotonically_increasing_id()))
    spans = shared_spans(suffix_array(suffixes(sets, similarity)), similarity)
    shared = F.size(F.array_intersect("words_x", "words_y"))
    pairs = (
        spans.join(sets.select(F.col("set_id").alias("x"), F.col("words").alias("words_x")), "x")
        .join(sets.select(F.col("set_id").alias("y"), F.col("words").alias("words_y")), "y")
        .withColumn("covered", shared)
        .withColumn("similarity", F.col("covered") / (F.size("words_x") + F.size("words_y") - F.col("covered")))
        .where(F.col("similarity") >= similarity)
        .select("x", "y", "covered", "similarity")
    )
    of = records.select(F.explode("splits").alias("split"), "qid", "k", "l").join(sets.select("k", "l", "set_id"), ["k", "l"])
    of_eval = of.where(F.col("split") != train).select(F.col("split").alias("eval_split"), F.col("qid").alias("eval_qid"), F.col("set_id").alias("x"))
    of_train = of.where(F.col("split") == train).select(F.col("qid").alias("p"), F.col("set_id").alias("y"))
    found = pairs.join(of_eval, "x").join(of_train, "y")
    return found.select("eval_split", "eval_qid", F.least("eval_qid", "p").alias("qid_a"), F.greatest("eval_qid", "p").alias("qid_b"), "similarity", "covered")
