"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.encode import Tokenizer
from corpuslens.plans.lineage import cut
from corpuslens.plans.sizes import small_side

#: Documents of one source and size class that one task puts in order.
BUCKET_ROWS = 200_000


def clean_source(col: str):
    """Sources compare without regard to case and outer blanks; an empty one is null."""
    c = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.when(c != "", c)


def sized_documents(documents: DataFrame, key: str, text: str, source: str, tokenizer: Tokenizer) -> DataFrame:
    """key, source, n_tokens of every document with a source and a text that isn't empty."""
    docs = documents.select(F.col(key).alias("key"), clean_source(source).alias("source"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["key"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = tokenizer.load()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                n = [len(encoding.encode_ordinary(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("source"), pa.array(n, pa.int64())], names=["key", "source", "n_tokens"])

    return docs.where("source IS NOT NULL AND length(text) > 0").mapInArrow(count, f"key {kind}, source string, n_tokens bigint")


def source_rates(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, weight, max_repeats, n_docs, n_tokens, rate: how often each document of a source is expected to be used.

    Without `total`, the mix is the largest one in which every source that has documents gets its weight exactly and
    none needs more than its repeats; the weights of listed sources without documents go to the others in proportion.
    With `total` (tokens), sources that cannot fill their share are used max_repeats times, and the others share what
    is left in proportion to their weights, as far as their own repeats allow. Repeated rows of a source in `targets`
    count once (the greatest weight, then repeats); null or non-positive weights or repeats, and null sources, are no
    targets. The windows hold one row for each target, never documents.
    """
    t = (
        targets.select(clean_source("source").alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats"))
        .where("source IS NOT NULL AND weight > 0 AND NOT isnan(weight) AND max_repeats > 0")
        .groupBy("source")
        .agg(F.max(F.struct("weight", "max_repeats")).alias("m"))
        .select("source", "m.weight", "m.max_repeats")
    )
    n = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    known = t.join(n, "source", "left").na.fill(0, ["n_docs", "n_tokens"]).withColumn("most", F.col("max_repeats") * F.col("n_tokens").cast("double"))
    every = Window.partitionBy(F.lit(1))
    present = F.when(F.col("n_tokens") > 0, F.col("weight"))
    share = present / F.sum(present).over(every)
    if total is None:
        filled = known.withColumn("share", share).withColumn("total", F.min(F.col("most") / F.col("share")).over(every))
        tokens = F.col("share") * F.col("total")
    else:
        # the sources that fill up first (least `most` for their weight) are capped while the level of the rest exceeds them
        ahead = Window.partitionBy(F.lit(1)).orderBy(F.col("most") / F.col("weight"), "source")
        filled = (
            known.withColumn("capped_before", F.coalesce(F.sum("most").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("weight_from", F.sum("weight").over(ahead.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", (F.lit(float(total)) - F.col("capped_before")) / F.col("weight_from"))
            .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
            .withColumn("level", F.max("fits").over(every))
        )
        tokens = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    rate = F.when(F.col("n_tokens") > 0, F.least(tokens / F.col("n_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return filled.select("source", "weight", "max_repeats", "n_docs", "n_tokens", F.greatest(rate, F.lit(0.0)).alias("rate"))


def mix_sources(sized: DataFrame, rates: DataFrame, seed: int = 42) -> DataFrame:
    """key, source, n_tokens, copies (at least 1) of the documents that are used.

    Within a source the documents stand in order of size class, then of a hash; the k-th one spans (k - 1, k] * rate of
    the expected copies, moved by one random offset of the source, and is used once for each whole number in its span,
    so at most max_repeats times. As near neighbours have near sizes, a source's tokens come close to their target.
    The places come from two prefix sums: of the counts of buckets within a source and of the rows within a bucket.
    The number of buckets follows the source's size, so that a source with a third of all rows is spread over tasks.
    """
    places = small_side(rates.where("rate > 0").select("source", "rate", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("int").alias("buckets")))
    order_hash = F.xxhash64(F.col("key"), F.lit(seed))
    docs = (
        sized.where("n_tokens > 0").join(places, "source")
        .withColumn("size_class", F.floor(F.log2(F.col("n_tokens").cast("double")) * 4).cast("int"))
        .withColumn("h", order_hash)
        .withColumn("bucket", F.pmod(F.shiftright("h", 17), F.col("buckets")).cast("int"))
    )
    keys = ["source", "size_class", "bucket"]
    before = Window.partitionBy("source").orderBy("size_class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = docs.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "key"))
    place = F.col("offset") + F.col("within")
    shift = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    spanned = docs.withColumn("within", within).join(offsets, keys).withColumn("shift", shift)
    copies = F.floor(place * F.col("rate") + F.col("shift")) - F.floor((place - 1) * F.col("rate") + F.col("shift"))
    return spanned.select("key", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: Tokenizer, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(selection, rates) for documents with doc_id, text, source; each text is tokenised once."""
    sized = cut(sized_documents(documents, "doc_id", "text", "source", tokenizer))
    rates = cut(source_rates(sized, targets, total))
    return mix_sources(sized, rates, seed), rates


def share_report(selection: DataFrame, rates: DataFrame) -> DataFrame:
    """For each listed source: what it has, what it was to get, and what it got."""
    got = selection.groupBy("source").agg(
        F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used")
    )
    every = Window.partitionBy(F.lit(1))  # one row for each target
    joined = rates.join(got, "source", "left").na.fill(0, ["docs_used", "most_copies", "tokens_used"])
    return joined.select(
        "source", "weight", "max_repeats", "n_docs", "n_tokens", "rate", "docs_used", "most_copies", "tokens_used",
        F.coalesce(F.try_divide("tokens_used", F.sum("tokens_used").over(every)), F.lit(0.0)).alias("share"),
    )
