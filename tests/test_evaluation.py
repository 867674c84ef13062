import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import efficiency, features, fusion, lexical, metrics, profile, qa, rerank, router, stats, vectors

RUN = "method string, qid string, doc_id string, score double"
QRELS = "qid string, doc_id string, rel int"
CORPUS = "doc_id string, title string, text string"


def run_of(spark, lists):
    return spark.createDataFrame([("m", q, d, float(s)) for q, docs in lists.items() for d, s in docs.items()], RUN)


def ev(spark, lists, qrels, ks=(1, 3, 10), **more):
    q = spark.createDataFrame([(a, b, c) for a, own in qrels.items() for b, c in own.items()], QRELS)
    return {r.qid: r.asDict() for r in metrics.evaluate(run_of(spark, lists), q, ks, **more).collect()}


def test_metrics_by_hand(spark):
    got = ev(spark, {"q": {"a": 3, "b": 2, "c": 1}}, {"q": {"a": 1, "c": 2, "z": 1}})["q"]
    dcg, ideal = 1 / math.log2(2) + 3 / math.log2(4), 3 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert got["ndcg_10"] == pytest.approx(dcg / ideal)
    assert got["ndcg_1"] == pytest.approx(1 / 3)
    assert got["recall_3"] == pytest.approx(2 / 3)
    assert got["p_10"] == pytest.approx(0.2)  # divided by k, though three came back
    assert got["map_10"] == pytest.approx((1 + 2 / 3) / 3)
    assert got["map_1"] == pytest.approx(1.0)  # divided by the smaller of k and the relevant


def test_metric_edges(spark):
    run = {"none": {"a": 1}, "neg": {"a": 2, "b": 1}, "tie": {"b": 1, "a": 1}, "unjudged": {"a": 1}}
    got = ev(spark, run, {"none": {"a": 0}, "neg": {"a": -1, "b": 1}, "tie": {"a": 1}, "absent": {"a": 1}})
    assert set(got) == {"none", "neg", "tie"}
    assert all(got["none"][f"{m}_10"] == 0 for m in ("ndcg", "recall", "map"))
    assert got["neg"]["ndcg_10"] == pytest.approx((-0.5 + 1 / math.log2(3)) / (1 - 0.5 / math.log2(3)))  # a negative gain
    assert got["tie"]["p_1"] == 1  # equal scores go by document
    asked = spark.createDataFrame([("m", "absent"), ("m", "tie")], "method string, qid string")
    again = ev(spark, run, {"tie": {"a": 1}, "absent": {"a": 1}}, run_queries=asked)
    assert again["absent"]["ndcg_10"] == 0 and set(again) == {"absent", "tie"}


def test_fusion(spark):
    a = run_of(spark, {"q": {"x": 4, "y": 2}}).drop("method")
    b = run_of(spark, {"q": {"y": -1, "z": 1}, "flat": {"k": 1}}).drop("method")
    got = {(r.qid, r.doc_id): r.score for r in fusion.hybrid(a, b, 0.4).collect()}
    # missing scores are 0 before both sides are brought to 0..1
    assert got[("q", "x")] == pytest.approx(0.4 * 1 + 0.6 * 0.5)
    assert got[("q", "y")] == pytest.approx(0.4 * 0.5)
    assert got[("q", "z")] == pytest.approx(0.6)
    assert got[("flat", "k")] == 0  # a constant side
    rr = {(r.qid, r.doc_id): r.score for r in fusion.rrf([a, b]).collect()}
    assert rr[("q", "y")] == pytest.approx(1 / 62 + 1 / 62)
    swept = fusion.alpha_sweep(a, b, [0.0, 0.4]).where("alpha = 0.4 AND doc_id = 'x'").first()
    assert swept.score == pytest.approx(0.7)


def test_bm25_by_hand_and_padding(spark):
    corpus = spark.createDataFrame([("d1", "", "renal renal trial"), ("d2", "", "trial"), ("d3", "", ""), ("d4", None, None)], CORPUS)
    q = spark.createDataFrame([("q1", "renal renal"), ("q2", "of the")], "qid string, text string")
    top = lexical.bm25(corpus, q, 3).collect()
    idf, norm = math.log(1 + (4 - 1 + 0.5) / 1.5), 1.5 * (0.25 + 0.75 * 3 / 1)
    assert [(r.qid, r.doc_id) for r in top] == [("q1", "d1")]
    assert top[0].score == pytest.approx(2 * idf * 2 / (2 + norm))  # a repeated query word adds again
    padded = lexical.bm25(corpus, q, 3, pad=True).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id) for r in padded] == [("q1", "d1"), ("q1", "d2"), ("q1", "d3"), ("q2", "d1"), ("q2", "d2"), ("q2", "d3")]
    assert lexical.bm25(corpus.limit(0), q, 3).count() == 0


def test_bm25_plan_has_no_cross_join_and_top_k_is_limited_early(spark):
    corpus = spark.createDataFrame([("d1", "", "renal trial")], CORPUS)
    plan = lexical.bm25(corpus, spark.createDataFrame([("q1", "renal")], "qid string, text string"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(300, 8)), 1)
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [1.0])], "doc_id bigint, embedding array<float>")
    got = vectors.dense_top_k(docs, docs.where("doc_id < 5").withColumnRenamed("doc_id", "qid"), 7)
    f = m.astype("float32").astype("float64")
    for q in range(5):
        s = np.round(f @ f[q], 6)
        assert [r.doc_id for r in got.where(F.col("qid") == q).orderBy("rank").collect()] == sorted(range(300), key=lambda i: (-s[i], i))[:7]
    assert vectors.dense_top_k(docs, docs.limit(0).withColumnRenamed("doc_id", "qid"), 7).count() == 0


def test_encoder_and_scorer_plug_in(spark):
    df = vectors.encode(spark.createDataFrame([("a b a",), (None,)], "t string"), "t", lambda: vectors.HashingEncoder(16), "query: ")
    assert [round(float(np.linalg.norm(r.embedding)), 4) for r in df.collect()] == [1.0, 1.0]

    class Length:
        def predict(self, pairs):
            return [len(t) for _, t in pairs]

    corpus = spark.createDataFrame([("d1", "", "xx"), ("d2", "t", "yyyy")], CORPUS)
    cand = spark.createDataFrame([("q", "d1"), ("q", "d2"), ("q", "gone")], "qid string, doc_id string")
    out = rerank.rerank(cand, spark.createDataFrame([("q", "z")], "qid string, text string"), corpus, rerank.model_score(Length))
    assert [(r.doc_id, r.rank) for r in out.orderBy("rank").collect()] == [("d2", 1), ("d1", 2)]
    assert [r.doc_id for r in rerank.missing_candidates(cand, corpus).collect()] == ["gone"]


def test_sparse_encoder_and_efficiency(spark):
    class Letters:
        def encode(self, texts):
            return [[(ord(c), float(i)) for i, c in enumerate(t)] for t in texts]

    df = spark.createDataFrame([(1, "aba"), (2, None), (3, "")], "doc_id bigint, text string")
    pooled = vectors.sparse_pool(vectors.encode_sparse(df, "doc_id", "text", Letters), "doc_id")
    assert {(r.doc_id, r.term): round(r.weight, 6) for r in pooled.collect()} == {(1, 97): round(math.log(3), 6), (1, 98): round(math.log(2), 6)}
    row = efficiency.efficiency(spark, {"x": (lambda: df, lambda: df.limit(1))}, 5).first()
    assert row.retriever == "x" and row.throughput > 0


def test_text_functions(spark):
    df = spark.createDataFrame([(" Maybe, but yes\n", "A-1 b Mab x9 anaemia", "\n"), ("no one knows", "", ""), ("", "What is it", "t")], "a string, b string, c string")
    rows = df.select(
        T.normalise_answer(F.col("a")).alias("n"), T.word_tokens(F.col("b")).alias("w"), T.medical_share(T.word_tokens(F.col("b"))).alias("m"), T.is_question(F.col("b")).alias("q"), T.prep_text("c", "b").alias("p"),
        T.format_prompt(F.col("b"), F.when(F.col("c") == "t", F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))).alias("f"),
    ).collect()
    assert [r.n for r in rows] == ["yes", "no", "unknown"]  # by the order of labels, not by place
    assert rows[0].w == ["a-1", "mab", "x9", "anaemia"] and rows[0].m == 0.5 and rows[1].m == 0.0
    assert [r.q for r in rows] == [0, 0, 1] and rows[2].p == "t What is it"
    assert "[1] x\n[2] y" in rows[2].f and T.NO_EVIDENCE in rows[1].f
    lists = spark.createDataFrame([("[1, 2]",), ("['a']",), ("junk",), (None,)], "l string").select(T.string_list(F.col("l")).alias("l")).collect()
    assert [r.l for r in lists] == [["1", "2"], ["a"], [], []]
    g = spark.createDataFrame([(0.0,), (0.1,), (-0.1,)], "g double").select(T.hoeffding_n(F.col("g")).alias("n")).collect()
    assert [r.n for r in g] == [10**9, 185, 185]


def test_features_edges(spark):
    corpus = spark.createDataFrame([("d1", "", "renal trial renal"), ("d2", "", "trial")], CORPUS)
    queries = spark.createDataFrame([("q1", "renal mystery mystery"), ("q2", "?"), ("q3", "renal")], "qid string, text string")
    qrels = spark.createDataFrame([("q1", "d1", 0), ("q1", "d2", 2), ("q2", "d1", 1), ("q3", "gone", 1)], QRELS)
    idf = features.idf_table(corpus)
    tech = {r.qid: r.tech for r in features.technicality(queries, idf).collect()}
    assert tech["q1"] == pytest.approx((math.log(3 / 2) + 1 + 1 + 1) / 3) and tech["q2"] == 0
    gap = {r.qid: r.gap for r in features.vocab_gap(queries, qrels, corpus).collect()}
    assert gap == {"q1": 0.5, "q2": 0.0, "q3": 1.0}


@pytest.mark.parametrize("n,sizes", [(322, [107, 107, 108]), (323, [108, 107, 108]), (3, [1, 1, 1])])
def test_strata_sizes(spark, n, sizes):
    df = spark.range(n).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("qid"), F.lit(1.0).alias("x"))
    rows = stats.stratify(df, "x", "qid", ["x"]).orderBy("stratum").collect()
    assert [r.n_queries for r in rows] == sizes


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 60
    x = rng.normal(size=(n, 3))
    y = x @ [0.5, -1, 0] + rng.normal(size=n) * 0.1 + 2
    df = spark.createDataFrame([(f"q{i:03d}", *map(float, x[i]), float(y[i])) for i in range(n)], "qid string, a double, b double, c double, y double")
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.lstsq(np.c_[np.ones(n), z], y, rcond=None)[0]
    got = {r.feature: r.coef for r in stats.ols(df, ["a", "b", "c"], "y").collect()}
    assert [got[k] for k in ("Intercept", "a", "b", "c")] == pytest.approx(list(want))
    boot = {r.feature: r for r in stats.ols_bootstrap(df, ["a", "b", "c"], "y", "qid", 300).collect()}
    assert boot["b"].ci_lo < want[2] < boot["b"].ci_hi and boot["b"].sig == "***"
    pb = stats.paired_bootstrap(df, "y", "a", "qid", 500).first()
    assert pb.mean_diff == pytest.approx((y - x[:, 0]).mean()) and pb.ci_lo < pb.mean_diff < pb.ci_hi and pb.p_a_gt_b == 1
    ranks = lambda v: np.argsort(np.argsort(v)) + 1.0
    rho = stats.with_p_value(stats.spearman(df, [("r", "a", "y")])).first()
    assert rho.spearman_rho == pytest.approx(np.corrcoef(ranks(x[:, 0]), ranks(y))[0, 1]) and 0 <= rho.p_value <= 1
    assert stats.t_two_sided(0.5, 12) == pytest.approx(0.0979, abs=1e-3)
    w = stats.wilcoxon(df, "a", "b").first()
    d = x[:, 0] - x[:, 1]
    r = ranks(abs(d))
    assert w.w == pytest.approx(min(r[d > 0].sum(), r[d < 0].sum())) and w.n_nonzero == n
    assert 0 <= stats.wilcoxon_p(w.n_nonzero, w.w, w.tie_sum) <= 1


def test_router_and_profile(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 0.1, 0.5, 0.5)], "qid string, x double, y double, z double")
    assert [r.l for r in df.select(router.label(["x", "y", "z"]).alias("l")).collect()] == [0, 1]
    h = profile.histogram(spark.createDataFrame([(float(v),) for v in (0, 1, 10)], "v double"), "v", 10)
    assert {r.bin: r.n for r in h.collect()} == {0: 1, 1: 1, 9: 1}
    assert profile.histogram(spark.createDataFrame([], "v double"), "v", 10).count() == 0
    p = qa.passages(spark.createDataFrame([(7, ["x", "y"])], "pubid int, c array<string>"), "pubid", "c")
    assert [(r.doc_id, r.text) for r in p.collect()] == [("7_p0", "x"), ("7_p1", "y")]

    class Echo:
        def generate(self, prompts):
            return ["maybe yes" for _ in prompts]

    a = qa.generate(spark.createDataFrame([("q", "p", "yes")], "qid string, prompt string, gold string"), Echo)
    assert qa.accuracy(a, ["qid"]).first().accuracy == 1.0


def test_two_encoders(spark):
    """Documents and queries are encoded apart from each other, and compared by brute force."""
    import zlib

    rng = random.Random(12)
    docs = [(f"d{i:02d}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    asked = [("q1", "a b a"), ("q2", "c"), ("q3", None)]
    d = vectors.encode(spark.createDataFrame(docs, "doc_id string, text string"), "text", lambda: vectors.HashingEncoder(16, damped=True))
    q = vectors.encode(spark.createDataFrame(asked, "qid string, text string"), "text", lambda: vectors.HashingEncoder(16))
    got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in vectors.dense_top_k(d, q, 3).collect()}

    def vector(text, damped):
        v = np.zeros(16)
        for w in (text or "").split():
            v[zlib.crc32(w.encode()) % 16] += 1
        v = np.log1p(v) if damped else v
        return v / (np.linalg.norm(v) or 1)

    for qid, text in asked:
        best = sorted(((-round(float(vector(text, False) @ vector(t, True)), 6), i) for i, t in docs))[:3]
        for n, (score, _) in enumerate(best, 1):
            assert got[(qid, n)][1] == pytest.approx(-score, abs=1e-5)
    assert len(got) == 9
