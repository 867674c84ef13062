"""The four contrasts of the reference, two of them from unrounded means over the test split."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from corpuslens import evaluation_queries as Q

SF = "/root/testdata/sf0.001"


def test_four_contrasts(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    got = {(r.a, r.b): r for r in E.queries()["n_required"](spark, SF).collect()}
    test = {r.method: r.ndcg_10 for r in Q._comparison(spark, SF).collect()}
    wide = Q._wide(spark, SF).agg(*[F.avg(c).alias(c) for c in ("bm25", "bge_small", "e5_small")]).first()
    gaps = {("bge_small", c): round(wide["bge_small"], 4) - round(wide[c], 4) for c in ("bm25", "e5_small")}
    gaps |= {("hybrid", "dense"): test["Hybrid"] - test["Dense"], ("dense", "bm25"): test["Dense"] - test["BM25"]}
    assert set(got) == set(gaps)
    for pair, gap in gaps.items():
        assert got[pair].observed_gap == pytest.approx(gap, abs=5.1e-5)
        assert got[pair].n_required == (10**9 if abs(gap) < 1e-12 else math.ceil(math.log(40) / (2 * gap**2)))
