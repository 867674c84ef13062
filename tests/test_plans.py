"""Plans: what is read, and what is never done."""

from pathlib import Path

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    return E.queries()[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["p1_found", "topk_per_query", "evaluate_wide", "hybrid_fusion", "rerank_top5", "feat_vocab_gap", "join_fusion_outer"])
def test_no_cross_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_only_needed_columns_are_read(spark):
    p = plan(spark, "p1_found").split("== Physical Plan ==")[1]
    reads = [x.split("ReadSchema: ")[1].split("\n")[0] for x in p.split("FileScan")[1:] if "ReadSchema: " in x]
    assert reads and not any("text" in r or "passage" in r or "source" in r for r in reads)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(method)" in plan(spark, "topk_per_query")


def test_top_k_is_limited_before_the_shuffle(spark):
    assert plan(spark, "topk_per_query").count("WindowGroupLimit") >= 2
