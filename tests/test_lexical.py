"""BM25 by blocks of documents against all scores at once, and what it sends on."""

import math
import random
from collections import Counter

import pytest

from corpuslens.operators import lexical

CORPUS = "doc_id string, title string, text string"


def _brute(corpus, queries, k):
    docs = {d: f"{title} {text}".split() for d, title, text in corpus}
    df, avgdl = Counter(w for t in docs.values() for w in set(t)), sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, text in queries:
        scores = {}
        for d, tokens in docs.items():
            tf = Counter(tokens)
            parts = [
                math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))
                for w in text.split()
                if tf[w]
            ]
            if parts:
                scores[d] = round(sum(parts), 6)
        for n, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:k], 1):
            out[q, n] = (d, scores[d])
    return out


@pytest.mark.parametrize("sent", [lexical.SENT, 40])
def test_bm25_in_blocks_and_turns(spark, sent):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([4, 20, 60])]) for _ in range(n))
    corpus = [(f"d{rng.randrange(10**6):06d}{i}", text(rng.randrange(3)), text(rng.randrange(1, 12))) for i in range(600)]
    corpus += [(f"same{i:03d}", "", "w0 w1 w59") for i in range(200)]  # ties beyond k
    queries = [(f"q{i}", text(rng.randrange(1, 7))) for i in range(40)] + [("tied", "w59 w0 w1"), ("none", "absent"), ("empty", "")]
    top = lexical.bm25(spark.createDataFrame(corpus, CORPUS).repartition(5), spark.createDataFrame(queries, "qid string, text string"), 7, sent=sent, docs=64)
    got = {(r.qid, r["rank"]): (r.doc_id, round(r.score, 6)) for r in top.collect()}
    want = _brute(corpus, queries, 7)
    assert {x: d for x, (d, _) in got.items()} == {x: d for x, (d, _) in want.items()}
    assert all(got[x][1] == pytest.approx(want[x][1], abs=2e-6) for x in want)
    assert [got["tied", n][0] for n in range(1, 8)] == [f"same{i:03d}" for i in range(7)]


def test_bm25_sends_on_the_best_only(spark):
    corpus = [(f"d{i}", "", " ".join(["trial"] * (1 + i % 9) + ["of"] * (i % 5))) for i in range(4000)]
    top = lexical.bm25(spark.createDataFrame(corpus, CORPUS), spark.createDataFrame([(f"q{i}", "trial") for i in range(50)], "qid string, text string"), 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # every match was a row that was joined and shuffled to be summed up
    assert top.count() == 150


def test_padding_ranks_what_was_found_once(spark):
    corpus = [(f"d{i:04d}", "", "trial" if i % 50 == 7 else "other") for i in range(400)]
    padded = lexical.bm25(spark.createDataFrame(corpus, CORPUS), spark.createDataFrame([("q1", "trial"), ("q2", "absent")], "qid string, text string"), 10, pad=True)
    assert "MapInArrow" not in padded._jdf.queryExecution().toString()  # else every document is scored for both of its uses
    found = [f"d{i:04d}" for i in range(7, 400, 50)]
    got = {q: [r.doc_id for r in padded.where(f"qid = '{q}'").orderBy("rank").collect()] for q in ("q1", "q2")}
    assert got == {"q1": found + ["d0000", "d0001"], "q2": [f"d{i:04d}" for i in range(10)]}


def test_best_score_of_each_query(spark):
    from corpuslens.evaluation_queries import feat_bm25_top1

    top = feat_bm25_top1(spark, "/root/testdata/sf0.001")
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # that of queries without a match; before, every match was joined and summed up, too
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    corpus, queries = [(f"d{i}", "", text(rng.randrange(1, 9))) for i in range(300)], [(f"q{i}", text(3)) for i in range(30)]
    got = {(r.qid, 1): r.doc_id for r in lexical.bm25(spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(queries, "qid string, text string"), 1, docs=50).collect()}
    assert got == {x: d for x, (d, _) in _brute(corpus, queries, 1).items()}
