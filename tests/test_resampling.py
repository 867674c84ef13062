"""Resamples are of as many queries as the tables' test split has judged."""

from pathlib import Path

import pytest

import __spark_entry__ as E
from corpuslens import evaluation_queries as Q
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def test_size_is_counted_in_the_tables(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    size = Q._subset_size(spark, SF)
    con = connect(SF)
    assert size == con.execute(f"SELECT count(DISTINCT qid) FROM ({E.oracle_sql()['load_collection']})").fetchone()[0] != 323
    assert {r.subset_size for r in E.queries()["resampling_summary"](spark, SF).collect()} == {size}
    for name in ("query_resampling", "resampling_summary"):
        assert differences(spark, con, SF, name, E.queries()[name], E.oracle_sql()[name]) == ""
