"""Hot groups and blocks: the ways that large inputs take give what the small ones do."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import metrics, stats, vectors
from corpuslens.plans import lineage


def test_ranks_of_a_hot_query(spark):
    rng = random.Random(3)
    rows = [("m", "hot" if i % 3 else f"q{i % 7}", f"d{i:05d}", round(rng.random(), 2)) for i in range(6000)] + [("m", None, "d", 1.0), ("m", None, "e", 2.0)]
    run = spark.createDataFrame(rows, "method string, qid string, doc_id string, score double")
    ranked = metrics.rank_run(run, ["method", "qid"])
    got = {(r.qid, r.doc_id): r["rank"] for r in ranked.collect()}
    want = {}
    for q in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == q), key=lambda r: (-r[3], r[2])), 1):
            want[(q, r[2])] = n
    assert got == want
    plan = ranked._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert metrics.rank_run(run.limit(0), ["method", "qid"]).count() == 0


@pytest.mark.parametrize("ids", ["string", "bigint"])
def test_dense_blocks_give_what_a_broadcast_gives(spark, ids):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(900)] + [(900, None), (901, [1.0])]
    v = spark.createDataFrame(rows, "i bigint, embedding array<float>")
    docs, queries = v.select(F.col("i").cast(ids).alias("doc_id"), "embedding"), v.where("i % 9 = 0").select(F.col("i").cast(ids).alias("qid"), "embedding")
    one = sorted(map(tuple, vectors.dense_top_k(docs, queries, 5).collect()))
    many = sorted(map(tuple, vectors.dense_top_k(docs, queries, 5, sent=10, query_block=10, doc_block=100).collect()))
    assert len(one) == 5 * 100 and one == many
    assert vectors.dense_top_k(docs, queries.limit(0), 5).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())


def test_discarded_tables_are_gone(spark):
    from pathlib import Path

    t = lineage.cut(spark.range(5))
    path = Path(t._cut_path.removeprefix("file:"))
    assert t.count() == 5 and path.exists()
    lineage.discard(t)
    assert not path.exists()


def test_draws_are_the_same_either_way(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i:03d}", *map(float, rng.normal(size=3))) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    near, far = ({r["_b"]: (r.a, r.y) for r in stats.replicate_means(df, ["a", "y"], "k", 50, 30, shared_rows=n).collect()} for n in (1000, 10))
    assert len(near) == 50 and all(near[b] == pytest.approx(far[b]) for b in near)
    near, far = ({r.feature: r for r in stats.ols_bootstrap(df, ["a", "b"], "y", "k", 200, shared_rows=n).collect()} for n in (1000, 10))
    assert all(near[f].ci_lo == pytest.approx(far[f].ci_lo) and near[f].ci_hi == pytest.approx(far[f].ci_hi) for f in ("Intercept", "a", "b"))
