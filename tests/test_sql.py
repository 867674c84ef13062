"""Every query with SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as E
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
#: Statistics of many resamples take long in either engine; test_evaluation holds their code against numpy.
SLOW = {"paired_bootstrap", "query_resampling", "resampling_summary", "ols_bootstrap"}


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(n for n in SQL if n not in SLOW and not n.startswith(("p2_", "p4_", "p5_", "p6_", "p7_", "p8_"))))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, SF, name, E.queries()[name], SQL[name]) == ""


def test_entry(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    assert E.entry(spark).count() > 0
