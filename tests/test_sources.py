import json

import pytest

from corpuslens.sources import collections as C
from corpuslens.sources import sinks
from corpuslens.sources.tables import current_rows


def write(folder, name, lines):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(lines) + "\n")


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "corpus.jsonl", [json.dumps(x) for x in ({"_id": "d1", "title": "T", "text": "x"}, {"_id": "d2", "text": "y"}, {"_id": "d2", "text": "y"})])
    write(tmp_path, "queries.jsonl", [json.dumps({"_id": q, "text": q}) for q in ("q1", "q2", "q3")])
    for s, rows in {"train": ["q3\td1\t1"], "dev": ["q1\td2\t2"], "test": ["q1\td1\t1", "q1\td1\t1", "q2\td2\t0"]}.items():
        write(tmp_path, f"qrels/{s}.tsv", ["query-id\tcorpus-id\tscore", *rows])
    return str(tmp_path)


def test_collection_and_splits(spark, folder):
    c = C.load_collection(spark, folder, "test")
    assert {(r.doc_id, r.title, r.text) for r in c.corpus.collect()} == {("d1", "T", "x"), ("d2", "", "y")} and c.corpus.count() == 2
    assert {r.qid for r in c.queries.collect()} == {"q1", "q2"} and c.qrels.count() == 2
    assert {(r.qid, r.split) for r in C.load_splits(spark, folder).queries.collect()} == {("q3", "train"), ("q1", "dev"), ("q1", "test"), ("q2", "test")}


def test_first_available(spark, folder):
    def fails():
        raise OSError("gone")

    found, label = C.first_available([("a", fails), ("b", lambda: None), ("c", lambda: C.load_collection(spark, folder))])
    assert label == "c" and found.qrels.count() == 2
    with pytest.raises(RuntimeError):
        C.first_available([("a", fails)])


def test_mirror(spark):
    passages = spark.createDataFrame([("1", "x"), ("2", "nan"), ("3", ""), (None, "y"), ("4", None)], "id string, passage string")
    questions = spark.createDataFrame([("a", "q?", "[1, 2]"), ("b", "", "[1]"), ("c", "r?", "junk"), ("d", "s?", None)], "qid string, question string, ids string")
    m = C.qa_mirror(passages, questions, C.parsed_ids(questions, "qid", "ids"))
    assert [(r.qid, r.doc_id, r.rel) for r in m.qrels.collect()] == [("a", "1", 1)] and [r.qid for r in m.queries.collect()] == ["a"]


def test_current_rows(spark):
    rows = [("a", 1, False, "old"), ("a", 3, False, "new"), ("a", 2, True, None), ("b", 1, False, "x"), ("b", 2, True, None), (None, 1, False, "n"), ("c", None, None, "c"), ("a", 3, False, "new")]
    df = spark.createDataFrame(rows, "k string, at int, gone boolean, v string")
    assert {(r.k, r.v) for r in current_rows(df, "k", "at", "gone", ["v"]).collect()} == {("a", "new"), ("c", "c")}


def test_current_rows_are_shuffled_once(spark):
    """the aggregation held each row twice, as max_by's value and again in its ordering, and so did the shuffle's files."""
    rows = [("a", 1, False, "x", None), ("a", 1, False, "x", "b"), ("a", None, False, "z", "z"), ("b", 2, None, None, "v"), ("c", 1, True, "x", "x"), ("c", 1, False, "x", "x")]
    now = current_rows(spark.createDataFrame(rows, "k string, at int, gone boolean, v string, w string"), "k", "at", "gone", ["v", "w"])
    assert {tuple(r) for r in now.collect()} == {("a", "x", "b"), ("b", None, "v")}
    plan = now._jdf.queryExecution().executedPlan()
    while "Exchange" not in plan.nodeName():
        plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else plan.children().head()
    assert plan.output().size() == 2  # the key and one row


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456), ("b", None)], "d string, v double")
    sinks.write_report(df, str(tmp_path / "r"))
    assert {(r.d, r.v) for r in C.read_report(spark, str(tmp_path / "r"), "d string, v double").collect()} == {("a", 0.1235), ("b", None)}
    sinks.write_manifest(df.limit(1), str(tmp_path / "m"))
    path = str(tmp_path / "t")
    sinks.write_table(df, path)
    filled = sinks.backfill(spark.read.parquet(path), spark.createDataFrame([("b", 2.0)], "d string, v double"), "d")
    sinks.rewrite(filled, path)
    assert {(r.d, r.v) for r in spark.read.parquet(path).collect()} == {("a", 0.123456), ("b", 2.0)}
    wide = sinks.per_query_wide(spark.createDataFrame([("m", "q", 1.0)], "method string, qid string, ndcg double"), ["m", "n"])
    assert [tuple(r) for r in wide.collect()] == [("q", 1.0, None)]


def test_sweep_report(spark):
    ev = spark.createDataFrame([("q1", "m", 0.5), ("q2", "m", 0.25), ("q1", "n", 1.0)], "qid string, method string, ndcg_10 double")
    registry = [C.Registered("a", "x", "bio"), C.Registered("b", "y"), C.Registered("c", "z", skip=frozenset({"n"}))]
    rows = {r.dataset: r for r in C.sweep_report({"a": ev, "c": ev}, registry, ["m", "n"]).collect()}
    assert (rows["a"].n_queries, rows["a"].m, rows["a"].n, rows["a"].domain) == (2, 0.375, 1.0, "bio")
    assert rows["b"].m is None and rows["b"].n_queries is None and rows["c"].n is None and rows["c"].notes == "skipped: n"


def test_written_collections_are_read_back(spark, tmp_path):
    docs = [("d 1", "T", 'line\nand "quote"'), ("d;2", "", ""), ("é", "\t", "  x ")]
    corpus = spark.createDataFrame(docs, "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q1", "a\tb"), ("q,2", "\\ \\")], "qid string, text string")
    qrels = spark.createDataFrame([("q1", "d 1", 2, "test"), ("q,2", "d;2", -1, "train"), ("q1", " é", 0, "train")], "qid string, doc_id string, rel int, split string")
    sinks.write_collection(corpus, queries, qrels, str(tmp_path / "c"))
    c = C.load_splits(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, c.corpus.collect())) == sorted(docs)
    assert sorted(map(tuple, c.qrels.select(*qrels.columns).collect())) == sorted(map(tuple, qrels.collect()))
    assert {(r.qid, r.text, r.split) for r in c.queries.collect()} == {("q1", "a\tb", "test"), ("q1", "a\tb", "train"), ("q,2", "\\ \\", "train")}
