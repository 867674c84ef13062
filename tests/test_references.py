import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpuslens.operators import references as R

T0 = datetime(2024, 1, 1)
PARENT = "_id string, loaded_at timestamp_ntz, deleted boolean, reason string, id string, at int"
CHILD = "row_no bigint, ref string, `other-ref` string, judged_at timestamp_ntz, ref_field string, id string, at string"


def run(spark, parent, child):
    history = R.load_history(spark.createDataFrame(parent, PARENT), "ref", "_id", "loaded_at", "deleted")
    refs = R.unpivot_references(spark.createDataFrame(child, CHILD), "row_no", ["ref"], "judged_at")
    return refs, history, {(r.row_no, r.reason) for r in R.orphan_references(refs, history).collect()}


def p(i, day, gone=False):
    return (i, None if day is None else T0 + timedelta(days=day), gone, "x", "y", 1)


def c(n, i, day):
    return (n, i, "z", None if day is None else T0 + timedelta(days=day), "x", "y", "z")


def test_reasons_times_and_spelling(spark):
    parent = [p("A", 1), p("a ", 5, True), p("A", 9), p("b", 3), p("c", 1), p("c", 2, True), p("d", None), p(None, 1), p("  ", 1), p("e", 1, None)]
    child = [
        c(1, "a", 0), c(2, " A\t", 1), c(3, "a", 5), c(4, "a", 8.5), c(5, "a", 9), c(6, "a", None), c(7, "b", 2), c(8, "c", None), c(9, "nope", 3),
        c(10, None, 3), c(11, " ", 3), c(12, "d", -900), c(13, "e", 2), c(13, "nope", 3),
    ]
    _, _, found = run(spark, parent, child)
    assert found == {(1, "late"), (3, "deleted"), (4, "deleted"), (7, "late"), (8, "deleted"), (9, "missing"), (13, "missing")}


def test_repeated_rows_and_empty_tables(spark):
    _, _, found = run(spark, [p("a", 1), p("a", 1), p("a", 1)], [c(1, "a", 1), c(1, "a", 1)])
    assert found == set()
    refs, history, found = run(spark, [], [c(1, "a", 1), c(1, "a", 1)])
    assert found == {(1, "missing")}
    assert R.orphan_references(refs, history).count() == 2  # a repeated row stays repeated
    assert run(spark, [p("a", 1)], [])[2] == set()


def test_against_brute_force_with_a_hot_id(spark):
    rng = random.Random(5)
    parent = [p(rng.choice(["hot", "hot", "x", "y"]), rng.randrange(0, 40) + rng.random(), rng.random() < 0.4) for _ in range(600)]
    child = [c(n, rng.choice(["hot", "Hot ", "x", "y", "z"]), None if rng.random() < 0.1 else rng.randrange(-2, 45) + rng.random()) for n in range(800)]
    want = set()
    for n, i, _, at, *_ in child:
        own = sorted((q[1], q[2]) for q in parent if q[0] == i.strip().lower())
        before = [g for t, g in own if at is None or t <= at]
        if not own:
            want.add((n, "missing"))
        elif not before:
            want.add((n, "late"))
        elif before[-1]:
            want.add((n, "deleted"))
    assert run(spark, parent, child)[2] == want


def test_report_counts(spark):
    refs, history, _ = run(spark, [p("a", 1)], [c(1, "a", 0), c(2, "a", 3), c(3, "b", 40), c(4, "b", None)])
    rows = {(r.month): (r.n_refs, r.n_orphans, r.n_missing, r.n_late) for r in R.orphan_report(refs, R.orphan_references(refs, history)).collect()}
    assert rows == {"2024-01": (2, 1, 0, 1), "2024-02": (1, 1, 1, 0), None: (1, 1, 1, 0)}


def test_hot_id_window_has_a_day_at_most(spark):
    refs, history, _ = run(spark, [p("a", 1)], [c(1, "a", 1)])
    plan = R.orphan_references(refs, history)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert history.select(F.col("id")).count() == 1
