"""Queries of the evaluation operators over the given tables.

Runs are the six methods of `retrieval`; first-stage retrieval is run on the stated query set (ids divisible by 50).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.evaluation_sql import SQL
from corpuslens.functions import text as T
from corpuslens.operators import features, fusion, lexical, metrics, profile, qa, rerank, router, sampling, stats, vectors
from corpuslens.plans.lineage import cut, scratch
from corpuslens.sources import collections as C
from corpuslens.sources import relations as L
from corpuslens.sources import sinks
from corpuslens.sources.tables import table

METHODS = ["BM25", "Dense", "BGE-small", "E5-small", "SPLADE", "MedCPT"]
STRATEGIES = ["bm25", "bge", "hybrid", "medcpt"]
ALPHAS = [round(0.1 * i, 1) for i in range(11)]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["QUERIES", "SQL"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, so that the order of additions doesn't show."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def big(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t == "int"})


def of(run: DataFrame, method: str) -> DataFrame:
    return run.where(F.col("method") == method).select("qid", "doc_id", "score")


def dev_qrels(s: SparkSession, d: str, split: str) -> DataFrame:
    return L.split_qrels(s, d).where(F.col("split") == split).select("qid", "doc_id", "rel")


# texts and tokens


@query
def prep_corpus(s, d):
    return L.corpus(s, d).select("doc_id", T.prep_text("title", "text").alias("content"))


@query
def tokens_word(s, d):
    t = T.word_tokens(T.prep_text("title", "text"))
    return L.corpus(s, d).select("doc_id", F.size(t).cast("bigint").alias("n"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"), F.array_join(t, " ").alias("tokens"))


@query
def tokens_bm25(s, d):
    t = T.retrieval_tokens(T.prep_text("title", "text"))
    return L.corpus(s, d).select("doc_id", F.size(t).cast("bigint").alias("n"), F.array_join(t, " ").alias("tokens"))


@query
def feat_is_question(s, d):
    return big(L.queries(s, d).select("qid", T.is_question(F.col("text")).alias("is_question")))


@query
def feat_med_share(s, d):
    return r6(L.queries(s, d).select("qid", T.medical_share(T.word_tokens(F.col("text"))).alias("med_share")))


@query
def qa_normalise(s, d):
    return L.corpus(s, d).select("doc_id", T.normalise_answer(F.col("text")).alias("answer"))


@query
def qa_to_qrels(s, d):
    rows = table(s, d, "qa_ds").select(F.coalesce("id", F.col("row_no").cast("string")).alias("qid"), "row_no", "question", "relevant_passage_ids")
    last = rows.groupBy("qid").agg(F.max_by(F.struct("question", "relevant_passage_ids"), "row_no").alias("r")).select("qid", "r.*")
    passages = L.corpus(s, d).select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    return big(C.qa_mirror(passages, last, C.parsed_ids(last, "qid", "relevant_passage_ids")).qrels)


@query
def qa_passages(s, d):
    lines = L.corpus(s, d).select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("contexts"))
    return qa.passages(lines, "doc_id", "contexts")


# sources and joins


@query
def load_collection(s, d):
    """Queries that are judged in the test split, as a loader keeps them."""
    return C.judged_queries(L.queries(s, d), dev_qrels(s, d, "test"))


@query
def collection_files(s, d):
    """The collection written in the layout of its files and read back by the loader: what each split holds."""
    path = scratch(s, "collection")
    sinks.write_collection(L.corpus(s, d), L.queries(s, d), L.split_qrels(s, d), path)
    c = C.load_splits(s, path)
    asked = c.queries.groupBy("split").agg(F.count("*").alias("n_queries"), F.sum(F.length("text")).alias("query_chars"))
    judged = c.qrels.groupBy("split").agg(F.count("*").alias("n_judgements"), F.sum("rel").alias("rel_sum"))
    docs = c.corpus.agg(F.count("*").alias("n_docs"), F.sum(F.length("title") + F.length("text")).alias("doc_chars"))  # one row
    return asked.join(judged, "split").join(F.broadcast(docs))


@query
def join_run_qrels(s, d):
    run = metrics.rank_run(L.run(s, d), ["method", "qid"], 10)
    j = run.join(L.qrels(s, d), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return j.groupBy("method", F.col("rel").cast("bigint").alias("rel")).agg(F.count("*").alias("n"))


@query
def join_fusion_outer(s, d):
    run = L.run(s, d)
    return r6(fusion.joined(of(run, "BM25"), of(run, "Dense")))


@query
def semi_judged(s, d):
    return L.qrels(s, d).join(L.corpus(s, d).select("doc_id"), "doc_id", "left_semi").groupBy("qid").agg(F.count("*").alias("n"))


@query
def anti_distractors(s, d):
    return L.corpus(s, d).select("doc_id").join(L.qrels(s, d).select("doc_id").distinct(), "doc_id", "left_anti")


@query
def subset_ids(s, d):
    return sampling.subset_ids(L.corpus(s, d), L.qrels(s, d))


@query
def subset_qrels(s, d):
    q = L.qrels(s, d)
    return big(sampling.subset_qrels(q, sampling.subset_ids(L.corpus(s, d), q)))


@query
def subset_sample(s, d):
    return L.corpus(s, d).select("doc_id").orderBy(sampling.sample_order("doc_id"), "doc_id").limit(500)


@query
def split_union(s, d):
    return L.qrels(s, d).groupBy("qid").agg(F.count("*").alias("n"), F.sum("rel").alias("rel_sum"))


@query
def first_n_queries(s, d):
    return L.queries(s, d).orderBy("qid").limit(50)


# rankings


@query
def rank_run(s, d):
    return big(r6(metrics.rank_run(L.run(s, d), ["method", "qid"])))


@query
def topk_per_query(s, d):
    return big(metrics.rank_run(L.run(s, d), ["method", "qid"], 5)).select("method", "qid", "rank", "doc_id")


@query
def minmax_norm(s, d):
    return r6(fusion.min_max(L.run(s, d), ["score"], ["method", "qid"]))


@query
def hybrid_fusion(s, d):
    run = L.run(s, d)
    return r6(fusion.hybrid(of(run, "BM25"), of(run, "Dense")))


@query
def rrf_fusion(s, d):
    run = L.run(s, d)
    return r6(fusion.rrf([of(run, "BM25"), of(run, "Dense")]))


# retrieval


@query
def bm25_index_stats(s, d):
    tokens = cut(lexical.token_table(L.corpus(s, d)))
    df, totals = lexical.index_stats(tokens, lexical.postings(tokens))
    return r6(df.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.max("df").alias("most")).join(F.broadcast(totals)))


@query
def bm25_topk(s, d):
    return big(r6(lexical.bm25(L.corpus(s, d), L.query_set(L.queries(s, d)))))


@query
def bm25_topk_padded(s, d):
    return big(r6(lexical.bm25(L.corpus(s, d), L.query_set(L.queries(s, d)), pad=True)))


@query
def feat_bm25_top1(s, d):
    q = L.query_set(L.queries(s, d))
    top = lexical.bm25(L.corpus(s, d), q, k=1)
    return r6(q.select("qid").join(top.select("qid", "score"), "qid", "left").select("qid", F.coalesce("score", F.lit(0.0)).alias("bm25_top1")))


@query
def dense_topk(s, d):
    v = table(s, d, "embeddings").where("embedding IS NOT NULL")
    docs = v.select(F.col("vec_id").alias("doc_id"), "embedding")
    return big(r6(vectors.dense_top_k(docs, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10)))


@query
def dual_encoder_topk(s, d):
    """Dense search with one encoder for the queries and another one for the documents, called as models are."""
    docs = vectors.encode(L.corpus(s, d).select("doc_id", T.prep_text("title", "text").alias("text")), "text", lambda: vectors.HashingEncoder(damped=True))
    asked = vectors.encode(L.query_set(L.queries(s, d)), "text", vectors.HashingEncoder)
    return big(r6(vectors.dense_top_k(docs, asked, 10)))


def _sparse(s, d, pick: str) -> DataFrame:
    """Components of the given vectors as term logits; the mask leaves the last one out."""
    v = table(s, d, "embeddings").where(pick).select("vec_id", F.posexplode("embedding").alias("term", "x"))
    return v.select("vec_id", F.col("term").cast("bigint").alias("term"), (F.col("x").cast("double") * 4.0).alias("logit"), (F.col("term") < 63).cast("double").alias("mask"))


@query
def sparse_pool(s, d):
    return r6(vectors.sparse_pool(_sparse(s, d, "vec_id IS NOT NULL"), "vec_id"))


@query
def sparse_topk(s, d):
    docs = vectors.sparse_pool(_sparse(s, d, "vec_id IS NOT NULL"), "vec_id").withColumnRenamed("vec_id", "doc_id")
    asked = vectors.sparse_pool(_sparse(s, d, "vec_id % 50 = 0"), "vec_id").withColumnRenamed("vec_id", "qid")
    return big(r6(vectors.sparse_top_k(docs, asked, 10)))


@query
def rerank_candidates(s, d):
    top = metrics.rank_run(of(L.run(s, d), "BM25"), ["qid"], 100)
    return big(r6(rerank.rerank(top, L.queries(s, d), L.corpus(s, d))))


@query
def rerank_top5(s, d):
    """The first five by a scorer of pairs that is called as a model is."""
    top = metrics.rank_run(of(L.run(s, d), "BM25"), ["qid"], 100)
    return big(r6(rerank.rerank(top, L.queries(s, d), L.corpus(s, d), rerank.model_score(rerank.OverlapScorer), k=5)))


@query
def rerank_delta(s, d):
    q, run = L.qrels(s, d), L.run(s, d)
    out = None
    for m in ("BM25", "BGE-small"):
        first = metrics.rank_run(of(run, m), ["qid"], 100)
        again = rerank.rerank(first, L.queries(s, d), L.corpus(s, d))
        both = first.select(F.lit("first").alias("stage"), "qid", "doc_id", "score").unionByName(again.select(F.lit("reranked").alias("stage"), "qid", "doc_id", "score"))
        means = metrics.evaluate(both, q, (10,), ("stage",)).groupBy(F.lit(m).alias("method")).pivot("stage", ["first", "reranked"]).agg(F.avg("ndcg_10"))
        out = means if out is None else out.unionByName(means)
    return r6(out.withColumn("delta", F.col("reranked") - F.col("first")))


# metrics


def _metric(name: str) -> Query:
    def f(s, d):
        ev = metrics.evaluate(L.run(s, d), L.qrels(s, d))
        return r6(ev.select("method", "qid", *[F.col(f"{name}_{k}") for k in metrics.KS]))

    f.__name__ = f"metric_{ {'p': 'precision'}.get(name, name)}"
    return query(f)


for _name in ("ndcg", "recall", "p", "map"):
    _metric(_name)


@query
def evaluate_wide(s, d):
    return r6(metrics.aggregate(metrics.evaluate(L.run(s, d), L.qrels(s, d)), ["method"]))


@query
def per_query_ndcg(s, d):
    return r6(metrics.per_query_ndcg(L.run(s, d), L.qrels(s, d)))


@query
def risk_summary(s, d):
    ev = metrics.evaluate(L.run(s, d), L.qrels(s, d), (10,))
    return r6(ev.groupBy("method").agg(F.count("*").alias("n_queries"), F.avg(1.0 - F.col("ndcg_10")).alias("risk"), F.var_samp(1.0 - F.col("ndcg_10")).alias("loss_variance")))


@query
def split_metrics(s, d):
    run, out = L.run(s, d), None
    three = run.where(F.col("method").isin("BM25", "Dense")).select("method", "qid", "doc_id", "score")
    three = three.unionByName(fusion.hybrid(of(run, "BM25"), of(run, "Dense")).withColumn("method", F.lit("Hybrid")))
    for split in ("train", "dev", "test"):
        agg = metrics.aggregate(metrics.evaluate(three, dev_qrels(s, d, split), (10,)), ["method"], (10,)).withColumn("split", F.lit(split))
        out = agg if out is None else out.unionByName(agg)
    return r6(out.select("split", "method", "n_queries", "ndcg_10", "recall_10", "p_10", "risk", "loss_variance"))


@query
def alpha_sweep(s, d):
    run = L.run(s, d)
    swept = fusion.alpha_sweep(of(run, "BM25"), of(run, "Dense"), ALPHAS)
    agg = metrics.aggregate(metrics.evaluate(swept, dev_qrels(s, d, "dev"), (10,), ("alpha",)), ["alpha"], (10,))
    best = F.max_by("alpha", F.struct(F.round("ndcg_10", 9), -F.col("alpha"))).over(Window.partitionBy(F.lit(1)))  # 11 rows
    return r6(agg.select("alpha", "ndcg_10", "recall_10", "p_10", "risk", best.alias("best_alpha")))


def _comparison(s, d) -> DataFrame:
    """Means over the test split, not rounded."""
    run = L.run(s, d)
    a, b = of(run, "BM25"), of(run, "Dense")
    all4 = None
    for name, r in (("BM25", a), ("Dense", b), ("Hybrid", fusion.hybrid(a, b)), ("RRF(k=60)", fusion.rrf([a, b]))):
        r = r.select(F.lit(name).alias("method"), "qid", "doc_id", "score")
        all4 = r if all4 is None else all4.unionByName(r)
    return metrics.aggregate(metrics.evaluate(all4, dev_qrels(s, d, "test"), (10,)), ["method"], (10,))


@query
def test_comparison(s, d):
    return r6(_comparison(s, d).select("method", "ndcg_10", "recall_10", "p_10", "risk", "loss_variance"))


def _by_source(s, d) -> DataFrame:
    """The collections of the run: the queries' sources."""
    sources = table(s, d, "queries_ds").where("source IS NOT NULL").groupBy(F.col("_id").alias("qid")).agg(F.min(F.lower(F.trim("source"))).alias("dataset"))
    return metrics.evaluate(L.run(s, d), L.qrels(s, d), (10,)).join(sources, "qid")


def _pivot(by_source: DataFrame) -> DataFrame:
    wide = by_source.groupBy("dataset").pivot("method", METHODS).agg(F.round(F.avg("ndcg_10"), 4))
    return wide.select("dataset", *[F.col(f"`{m}`").alias(m.lower().replace("-", "_")) for m in METHODS])


@query
def multi_dataset_pivot(s, d):
    return _pivot(_by_source(s, d))


@query
def report_backfill(s, d):
    """A report of all collections but one, which has a row of nulls, and that row filled in by its own evaluation later."""
    rows = cut(_by_source(s, d))
    later = F.col("dataset") == "qamini"
    report = _pivot(rows.where(~later))
    placeholder = rows.where(later).select("dataset").distinct().select("dataset", *[F.lit(None).cast("double").alias(c) for c in report.columns[1:]])
    return sinks.backfill(report.unionByName(placeholder), _pivot(rows.where(later)), "dataset")


def _wide(s, d) -> DataFrame:
    """qid and the nDCG@10 of each method for judged queries; null where a method did not run a query."""
    ev = metrics.evaluate(L.run(s, d), L.qrels(s, d), (10,)).withColumnRenamed("ndcg_10", "ndcg")
    return sinks.per_query_wide(ev, METHODS).select("qid", *[F.col(f"`{m}`").alias(m.lower().replace("-", "_")) for m in METHODS])


def _compared(s, d) -> DataFrame:
    """The judged queries that both runs of a comparison have."""
    return _wide(s, d).where("bm25 IS NOT NULL AND dense IS NOT NULL").select("qid", "bm25", "dense")


@query
def per_query_pivot(s, d):
    return r6(_wide(s, d))


@query
def win_tie_loss(s, d):
    a, b = F.round("bm25", 9), F.round("dense", 9)
    return _compared(s, d).agg(F.count(F.when(a > b, 1)).alias("wins"), F.count(F.when(a == b, 1)).alias("ties"), F.count(F.when(a < b, 1)).alias("losses"))


@query
def n_required(s, d):
    """Four contrasts: two of means rounded to 4 decimals over all judged queries, two of unrounded means over the test split."""
    means = _wide(s, d).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("bm25", "bge_small", "e5_small")])
    test = _comparison(s, d).agg(*[F.max(F.when(F.col("method") == m, F.col("ndcg_10"))).alias(f"test_{m.lower()}") for m in ("BM25", "Dense", "Hybrid")])
    pairs = [("bge_small", "bm25", ""), ("bge_small", "e5_small", ""), ("hybrid", "dense", "test_"), ("dense", "bm25", "test_")]
    gap = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(of + a) - F.col(of + b), 12).alias("gap")) for a, b, of in pairs]
    c = means.join(F.broadcast(test)).select(F.explode(F.array(*gap)).alias("r")).select("r.*")  # one row each
    return c.select("a", "b", F.round("gap", 4).alias("observed_gap"), T.hoeffding_n(F.col("gap")).alias("n_required"))


@query
def index_memory(s, d):
    """The size label of a dense index of 384 dimensions over the corpus."""
    n = L.corpus(s, d).agg(F.count("*").alias("n_docs"))
    mb = F.floor(F.col("n_docs") * 384 * 4 / (1024.0 * 1024.0))
    return n.select("n_docs", F.concat(mb.cast("string"), F.lit(" MB ("), F.col("n_docs").cast("string"), F.lit(" x 384 f32)")).alias("memory"))


# features


@query
def idf_table(s, d):
    return r6(features.idf_table(L.corpus(s, d)))


@query
def feat_tech(s, d):
    return r6(features.technicality(L.queries(s, d), features.idf_table(L.corpus(s, d))))


@query
def feat_vocab_gap(s, d):
    return r6(features.vocab_gap(L.queries(s, d), L.qrels(s, d), L.corpus(s, d)))


def _features(s, d) -> DataFrame:
    return features.router_features(L.queries(s, d), L.qrels(s, d), L.corpus(s, d), of(L.run(s, d), "BM25").select("qid", "score"))


@query
def router_features(s, d):
    return r6(big(_features(s, d)))


def _study(s, d) -> DataFrame:
    """Features and the nDCG@10 of three runs for the judged queries that all of them have."""
    run = L.run(s, d)
    a, b = of(run, "BM25"), of(run, "Dense")
    three = None
    for name, r in (("bm25", a), ("dense", b), ("hybrid", fusion.hybrid(a, b))):
        r = r.select(F.lit(name).alias("method"), "qid", "doc_id", "score")
        three = r if three is None else three.unionByName(r)
    ev = metrics.evaluate(three, L.qrels(s, d), (10,)).withColumnRenamed("ndcg_10", "ndcg")
    wide = sinks.per_query_wide(ev, ["bm25", "dense", "hybrid"]).na.drop()
    wide = wide.withColumn("dense_minus_bm25", F.col("dense") - F.col("bm25")).withColumn("hybrid_minus_dense", F.col("hybrid") - F.col("dense"))
    surface = features.surface(L.queries(s, d)).select("qid", "len")
    gap = features.vocab_gap(L.queries(s, d), L.qrels(s, d), L.corpus(s, d))
    tech = features.technicality(L.queries(s, d), features.idf_table(L.corpus(s, d)))
    return wide.join(surface, "qid").join(gap, "qid").join(tech, "qid")


# statistics


@query
def spearman(s, d):
    rows = _study(s, d).withColumn("overlap", 1.0 - F.col("gap"))
    pairs = [("gap vs bm25", "gap", "bm25"), ("gap vs dense", "gap", "dense"), ("gap vs hybrid", "gap", "hybrid"), ("overlap vs dense - bm25", "overlap", "dense_minus_bm25")]
    return r6(stats.spearman(rows, pairs))


@query
def wilcoxon(s, d):
    return r6(stats.wilcoxon(_compared(s, d), "dense", "bm25"))


@query
def wilcoxon_p(s, d):
    """The signed-rank statistic with its two-sided p-value (normal approximation with tie correction)."""
    w = stats.wilcoxon(_compared(s, d), "dense", "bm25").select("n_nonzero", "w", "tie_sum").first()  # one row
    p = stats.wilcoxon_p(w["n_nonzero"], w["w"], w["tie_sum"])
    return s.createDataFrame([("Dense - BM25", w["n_nonzero"], w["w"], p)], "contrast string, n_nonzero bigint, w double, p_value double")


@query
def spearman_p(s, d):
    """Spearman's correlations with their two-sided p-values."""
    return stats.with_p_value(spearman(s, d))


@query
def paired_bootstrap(s, d):
    return r6(stats.paired_bootstrap(_compared(s, d), "dense", "bm25", "qid", replicates=10_000))


TRIAL_COLUMNS = ["bm25", "dense", "hybrid", "dense_minus_bm25", "hybrid_minus_dense"]


def _subset_size(s, d) -> int:
    """Queries that are judged in the test split: so many are drawn in each trial."""
    return load_collection(s, d).select("qid").distinct().count()


def _trials(s, d, size: int) -> DataFrame:
    study = _study(s, d)
    if not size:  # nothing is judged in test, so nothing can be drawn
        study = study.limit(0)
    return stats.replicate_means(study, TRIAL_COLUMNS, "qid", 2000, size)


@query
def query_resampling(s, d):
    trials = _trials(s, d, _subset_size(s, d))
    return r6(trials.withColumnRenamed("_b", "trial"))


@query
def resampling_summary(s, d):
    size = _subset_size(s, d)
    return r6(stats.summary(_trials(s, d, size), TRIAL_COLUMNS)).withColumn("subset_size", F.lit(size).cast("bigint"))


@query
def stratify_gap(s, d):
    return big(r6(stats.stratify(_study(s, d), "gap", "qid", TRIAL_COLUMNS)))


@query
def stratify_tech(s, d):
    return big(r6(stats.stratify(_study(s, d), "tech", "qid", TRIAL_COLUMNS)))


@query
def ols_delta(s, d):
    return r6(stats.ols(_study(s, d), ["gap", "len", "tech"], "dense_minus_bm25"))


@query
def ols_bootstrap(s, d):
    return r6(stats.ols_bootstrap(_study(s, d), ["gap", "len", "tech"], "dense_minus_bm25", "qid", replicates=10_000))


# profiles


@query
def profile_collection(s, d):
    docs = L.corpus(s, d).select(T.prep_text("title", "text").alias("text"))
    return r6(profile.length_stats(docs, "text", "documents").unionByName(profile.length_stats(L.queries(s, d), "text", "queries")))


@query
def profile_judgements(s, d):
    return r6(profile.judgements(L.qrels(s, d)))


@query
def profile_splits(s, d):
    return profile.splits(L.split_qrels(s, d), L.queries(s, d))


@query
def profile_query_histogram(s, d):
    lengths = L.queries(s, d).select(profile.n_words(F.col("text")).alias("n_words"))
    return big(profile.histogram(lengths, "n_words", 50))


@query
def profile_grades(s, d):
    return big(r6(profile.grades(L.qrels(s, d))))


@query
def profile_histogram(s, d):
    lengths = L.corpus(s, d).select(profile.n_words(T.prep_text("title", "text")).alias("n_words"))
    return big(profile.histogram(lengths, "n_words", 50))


@query
def profile_examples(s, d):
    return big(profile.examples(L.queries(s, d), L.qrels(s, d), L.corpus(s, d)))


# routing


def _strategies(s, d) -> DataFrame:
    """qid and the nDCG@10 of the four strategies for the judged queries that all of them have."""
    run = L.run(s, d)
    hybrid = fusion.hybrid(of(run, "BM25"), of(run, "BGE-small")).select(F.lit("hybrid").alias("method"), "qid", "doc_id", "score")
    ev = metrics.evaluate(hybrid, L.qrels(s, d), (10,)).select("qid", F.col("ndcg_10").alias("hybrid"))
    return _wide(s, d).join(ev, "qid").select("qid", "bm25", F.col("bge_small").alias("bge"), "hybrid", "medcpt").na.drop()


def _given_features(s, d) -> DataFrame:
    """split, qid and the features of feat_rows: its last row for each query and split; missing values count 0."""
    rows = table(s, d, "feat_rows")
    name = F.lower(T.strip(F.col("split")))
    rows = rows.withColumn("split", F.when(name.isin("val", "validation"), "dev").otherwise(name)).where("qid IS NOT NULL AND split IS NOT NULL")
    last = rows.groupBy("split", "qid").agg(F.max(F.struct("computed_at", *router.FEATURES)).alias("r")).select("split", "qid", "r.*")
    clean = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in router.FEATURES}
    return last.withColumns(clean).drop("computed_at")


@query
def router_label(s, d):
    return big(_strategies(s, d).select("qid", router.label(STRATEGIES).alias("label")))


@query
def router_oracle(s, d):
    return r6(_strategies(s, d).agg(F.avg(F.greatest(*STRATEGIES)).alias("value"), F.count("*").alias("n_queries")))


@query
def router_policy_value(s, d):
    """The value of a fixed rule: long queries go to the lexical run, others to the hybrid one."""
    rows = _strategies(s, d).join(features.surface(L.queries(s, d)), "qid").withColumn("pick", F.when(F.col("len") >= 9, 0).otherwise(2))
    return r6(router.policy_value(rows, STRATEGIES))


@query
def router_baselines(s, d):
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("v")) for c in STRATEGIES], F.struct(F.lit("oracle").alias("method"), F.greatest(*STRATEGIES).alias("v")))).alias("r")
    means = _strategies(s, d).select(long).select("r.*").groupBy("method").agg(F.avg("v").alias("ndcg_10"))
    return r6(means.withColumn("risk", 1.0 - F.col("ndcg_10")))


@query
def router_report(s, d):
    """The four fixed strategies, two learned routers and the oracle: risks on train and dev and on test, with their gap."""
    rows = cut(_given_features(s, d).join(_strategies(s, d), "qid").withColumn("label", router.label(STRATEGIES).cast("double")))
    train, test = rows.where("split <> 'test'"), rows.where("split = 'test'")
    forest, _ = router.trees(train, train, test)
    picks = {"logistic": router.logistic(train, train, test), "trees": forest, "oracle": [f.withColumn("pick", router.label(STRATEGIES)) for f in (train, test)]}
    picks = {c: [f.withColumn("pick", F.lit(i)) for f in (train, test)] for i, c in enumerate(STRATEGIES)} | picks
    out = None
    for name, (a, b) in picks.items():
        risk = 1.0 - F.avg(router.chosen(STRATEGIES, "pick"))
        r = a.agg(risk.alias("r_train")).join(F.broadcast(b.agg(risk.alias("r_test"))))  # one row each
        r = r.select(F.lit(name).alias("router"), "r_train", "r_test", (F.col("r_test") - F.col("r_train")).alias("gap"))
        out = r if out is None else out.unionByName(r)
    return out


@query
def router_importance(s, d):
    rows = _given_features(s, d).where("split <> 'test'").join(_strategies(s, d), "qid").withColumn("label", router.label(STRATEGIES).cast("double"))
    _, importance = router.trees(rows)
    return s.createDataFrame(importance, "feature string, importance double")


# answering


def _contexts(s, d, method: str) -> DataFrame:
    ranked = metrics.rank_run(of(L.run(s, d), method), ["qid"], 5)
    asked = C.judged_queries(L.queries(s, d), L.qrels(s, d))
    return qa.contexts(asked, ranked, L.corpus(s, d))


@query
def qa_contexts(s, d):
    return _contexts(s, d, "BM25").select("qid", F.size("passages").cast("bigint").alias("n_passages"), F.array_join("passages", "\n").alias("passages"))


@query
def qa_prompt(s, d):
    return qa.prompts(_contexts(s, d, "BM25"))


@query
def qa_accuracy(s, d):
    """Answers from four kinds of evidence (none, two runs, the second one reranked), by a generator that is called as a
    model is, against the answer read off the best judged document."""
    best = L.qrels(s, d).join(L.corpus(s, d), "doc_id").groupBy("qid").agg(F.max_by("text", F.struct("rel", "doc_id")).alias("t")).select("qid", T.normalise_answer(F.col("t")).alias("gold"))
    asked = C.judged_queries(L.queries(s, d), L.qrels(s, d))
    hundred = metrics.rank_run(of(L.run(s, d), "BGE-small"), ["qid"], 100)
    reranked = rerank.rerank(hundred, L.queries(s, d), L.corpus(s, d), rerank.model_score(rerank.OverlapScorer), k=5)
    evidence = {
        "none": asked.select("qid", "text", F.array().cast("array<string>").alias("passages")),
        "BM25": _contexts(s, d, "BM25"), "BGE-small": _contexts(s, d, "BGE-small"),
        "reranked": qa.contexts(asked, reranked, L.corpus(s, d)),
    }
    out = None
    for name, rows in evidence.items():
        p = qa.prompts(rows).withColumn("method", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return qa.accuracy(qa.generate(out, qa.EvidenceReader).join(best, "qid"), ["method"])
