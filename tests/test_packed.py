import pytest
from pyspark.sql import functions as F

from corpuslens.functions.packed import explode_packed, unpack_values

CASES = [
    (None, []), ("", []), (" \t ", []), ("nan", []), ("n/a", []), ("[]", []), ("{}", []), ("; ;", []), ("...", []),
    ("nu-1", ["nu-1"]), (" nu-1\n", ["nu-1"]), ("nu-1,nu-2", ["nu-1", "nu-2"]), ("nu-1, nu-1", ["nu-1", "nu-1"]),
    ("a1||b2| c3 ;d4", ["a1", "b2", "c3", "d4"]), ("a1、b2，c3；d4", ["a1", "b2", "c3", "d4"]), ("a1\r\nb2\tc3", ["a1", "b2", "c3"]),
    ("['a1' 'b2'\n 'c3']", ["a1", "b2", "c3"]), ('["pm 1", "pm2,v3","pm4;s5"]', ["pm 1", "pm2,v3", "pm4;s5"]), ("{'a1', 'b/2'}", ["a1", "b/2"]),
    ('"[\\"a1\\", \\"pm 2\\"]"', ["a1", "pm 2"]), ('a1,"pm 2",c3', ["a1", "pm 2", "c3"]), ("[a1, b2, ...]", ["a1", "b2"]), ("[a1, b2,", ["a1", "b2"]),
    ("see a1 and b2 & c3", ["a1", "b2", "c3"]), ("ids: a1", ["a1"]), ("a1 und b2.", ["a1", "b2"]), ('"[a1, b2]"', ["a1", "b2"]),
    ("“a1” «b 2»", ["a1", "b 2"]), ('a1, "b 2', ["a1", "b 2"]), ("cl1_p6", ["cl1_p6"]),
]


@pytest.fixture(scope="module")
def split(spark):
    df = spark.createDataFrame([(i, x, "extra") for i, (x, _) in enumerate(CASES)], "row_no bigint, packed string, pos string")
    out: dict[int, list] = {}
    for r in explode_packed(df, "row_no", "packed", "v").collect():
        out.setdefault(r.row_no, []).append((r.pos, r.v))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(split, i):
    assert sorted(split.get(i, [])) == list(enumerate(CASES[i][1], 1))


def test_long_field_and_empty_table(spark):
    long = ",".join(f'"id {k}"' if k % 7 == 0 else f"id{k}" for k in range(20_000))
    rows = explode_packed(spark.createDataFrame([(1, long)], "row_no bigint, packed string"), "row_no", "packed", "v").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.pos)] == [f"id {k}" if k % 7 == 0 else f"id{k}" for k in range(20_000)]
    assert explode_packed(spark.createDataFrame([], "row_no bigint, packed string"), "row_no", "packed", "v").count() == 0


def test_time_is_linear_in_the_field(spark):
    import time

    field = ", ".join(f"'id {i}'" for i in range(16_000))
    df = spark.createDataFrame([(1, field)], "k int, f string").select(F.size(unpack_values(F.col("f"))).alias("n"))
    df.collect()
    began = time.perf_counter()
    assert df.collect()[0].n == 16_000
    assert time.perf_counter() - began < 3
