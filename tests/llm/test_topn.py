import random

import pytest

from corpuslens.llm import topn

ITEMS = "method string, qid string, doc_id string, score double, top_k int, pos int, part int, local_pos string, n_here string, _n int"


def item(m, q, d, s, k=3):
    return (m, q, d, s, k, 1, 2, "x", "y", 3)


def best(items, named, partitions=None):
    limits = {}
    for m, q, _, _, k, *_ in items:
        if k is not None and q in named:
            limits[m, q] = max(k, limits.get((m, q), 0))
    scores = {}
    for m, q, d, s, *_ in items:
        if None not in (m, q, d, s) and s == s:
            scores[m, q, d] = max(s, scores.get((m, q, d), s))
    out = set()
    for (m, q), n in limits.items():
        own = sorted(((-s, d) for (a, b, d), s in scores.items() if (a, b) == (m, q)))
        out |= {(m, q, i, d) for i, (_, d) in enumerate(own[:n], 1)}
    return out


def run(spark, items, named, partitions=None):
    df = spark.createDataFrame(items, ITEMS)
    limits = topn.group_limits(df, ["method", "qid"], "top_k", spark.createDataFrame([(q, "x") for q in named], "qid string, top_k string"), "qid")
    out = topn.top_n_per_group(df.repartition(5), ["method", "qid"], "doc_id", "score", limits, "top_k", partitions)
    return [(r.method, r.qid, r.pos, r.doc_id) for r in out.collect()]


@pytest.fixture(params=[10_000, 37])
def batch_rows(spark, request):
    """Groups cross batches, too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_hot_group_over_many_partitions(spark, partitions, batch_rows):
    rng = random.Random(partitions)
    items = [item("m", "hot", f"d{rng.randrange(900)}", rng.randrange(40) / 4, 25) for _ in range(3000)]
    items += [item(rng.choice("mn"), f"q{rng.randrange(40)}", f"d{rng.randrange(50)}", rng.choice([0.5, 1.0, None, float("nan")]), rng.choice([2, 5, None])) for _ in range(900)]
    items += [item("m", None, "d", 1.0), item(None, "hot", "d", 1.0), item("m", "hot", None, 9.0)]
    got = run(spark, items, ["hot", None, *[f"q{i}" for i in range(0, 40, 2)], "absent"], partitions)
    assert len(got) == len(set(got))
    assert set(got) == best(items, {"hot", *[f"q{i}" for i in range(0, 40, 2)]})


def test_code_point_order_and_case(spark):
    items = [item("m", "q", d, 1.0, 10) for d in ("b", "B", "a", "é", "￿", "𐀀", "10", "9")]
    got = sorted(run(spark, items, ["q"]), key=lambda r: r[2])
    assert [r[3] for r in got] == sorted(("b", "B", "a", "é", "￿", "𐀀", "10", "9"))


def test_empty(spark):
    assert run(spark, [], ["q"]) == []
    assert run(spark, [item("m", "q", "d", 1.0, None)], ["q"]) == []
    assert run(spark, [item("m", "q", "d", 1.0)], []) == []
