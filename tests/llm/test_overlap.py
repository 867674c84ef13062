import random
import re

from pyspark.sql import functions as F

from corpuslens.llm import overlap

WORD = re.compile(r"[^\W_]+")


def brute(roster, texts, t):
    sets = {q: frozenset(WORD.findall(x.lower())) for q, x in texts if q and x}
    sets = {q: s for q, s in sets.items() if s}
    out = set()
    for s, q in roster:
        for s2, r in roster:
            if s in ("dev", "test") and s2 == "train" and q in sets and r in sets:
                if q == r or len(sets[q] & sets[r]) >= t * len(sets[q] | sets[r]):
                    out.add((s, min(q, r), max(q, r)))
    return out


def run(spark, roster, texts, t=0.75):
    r = spark.createDataFrame([(s, q, "x", "y") for s, q in roster], "split string, qid string, words string, set_id string")
    x = spark.createDataFrame([(q, v, "x", "y") for q, v in texts], "qid string, text string, split string, lead string")
    rows = overlap.split_overlaps(r, x, ["dev", "test"], "train", t).collect()
    assert len(rows) == len({(r.eval_split, r.eval_qid, r.qid_a, r.qid_b) for r in rows})
    return {(r.eval_split, r.qid_a, r.qid_b) for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts, roster = [], []
    for i in range(400):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))] + ["the", "of"][: rng.randrange(3)]
        for k in range(2):
            w = list(base)
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
            rng.shuffle(w)
            q = f"q{i}-{k}"
            texts.append((q, rng.choice([" ", ", ", " - "]).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
            roster += [(rng.choice(["train", "dev", "test"]), q) for _ in range(rng.randrange(1, 3))]
    for t in (0.75, 0.9, 0.5):
        assert run(spark, roster, texts, t) == brute(roster, texts, t)


def test_edges(spark):
    texts = [("a", "x y z w"), ("b", "X, Y. Z w"), ("c", ""), ("d", None), ("e", "?!"), (None, "x y z w"), ("f", "x y z w"), ("g", " ".join(f"w{i}" for i in range(3000))), ("h", " ".join(f"w{i}" for i in range(10, 3000)))]
    roster = [("train", "a"), ("dev", "a"), ("test", "b"), ("test", "b"), ("dev", "c"), ("train", "c"), ("dev", "d"), ("train", "d"), ("dev", "e"), ("train", "e"), ("dev", None), (None, "f"), ("other", "f"), ("dev", "gone"), ("train", "gone"), ("dev", "g"), ("train", "h")]
    assert run(spark, roster, texts) == {("dev", "a", "a"), ("test", "a", "b"), ("dev", "g", "h")}
    assert run(spark, [], texts) == set() and run(spark, roster, []) == set()


def test_copies_meet_once_as_sets(spark):
    texts = [(f"q{i:03d}", "same words in any order") for i in range(60)]
    roster = [("train" if i % 2 else "dev", q) for i, (q, _) in enumerate(texts)]
    assert run(spark, roster, texts) == brute(roster, texts, 0.75)


def test_suffix_array_against_brute_force(spark):
    """Sorted over all partitions; neighbours with a common prefix are one interval, across the partitions' edges, too."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 6))]) for i in range(300)]
    needed = spark.createDataFrame(rows, "set_id long, suffix array<bigint>")
    for span in (1, 2, 3):
        got = overlap.suffix_array(needed, span).collect()
        by_interval = {}
        for r in got:
            by_interval.setdefault((r.part, r.interval), []).append(r)
        want = {}
        for i, s in rows:
            want.setdefault(tuple(s[:span]) if len(s) >= span else (i,), set()).add(i)
        assert len(got) == 300 and len({r.part for r in got}) > 1
        assert {frozenset(r.set_id for r in own) for own in by_interval.values()} == {frozenset(own) for own in want.values()}


def test_order_makes_the_intervals(spark, monkeypatch):
    """Without the sort, neighbours share nothing and pairs are missed."""
    texts = [(f"q{i}", f"topic{i % 40} of interest number{i % 40} in house{i % 40}") for i in range(160)]
    roster = [("train" if i < 80 else "dev", q) for i, (q, _) in enumerate(texts)]
    texts = [(q, t + (f" extra{i}" if i % 3 == 0 else "")) for i, (q, t) in enumerate(texts)]
    want = brute(roster, texts, 0.75)
    assert run(spark, roster, texts) == want
    from pyspark.sql import DataFrame

    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", lambda self, *a: self.orderBy(F.xxhash64("set_id", "start")) if "start" in self.columns else DataFrame.sortWithinPartitions(self, *a))
    assert len(run(spark, roster, texts)) < len(want)


def test_coverage_is_over_whole_texts(spark):
    long = [f"w{i}" for i in range(60)]
    r = spark.createDataFrame([("train", "a"), ("dev", "b")], "split string, qid string")
    x = spark.createDataFrame([("a", " ".join(long)), ("b", " ".join(long[:55]))], "qid string, text string")
    got = overlap.split_overlaps(r, x, ["dev"], "train", 0.75).collect()
    assert [(o.qid_a, o.qid_b, o.covered) for o in got] == [("a", "b", 55)]


def test_a_hot_interval_is_compared_in_blocks(spark, monkeypatch):
    """A third of all queries are of one template: blocks of any size give the same pairs, each of them once."""
    rng = random.Random(7)
    base = [f"t{k}" for k in range(12)]
    texts = [(f"t{i:04d}", " ".join(base[: 12 - i % 5] + [f"e{rng.randrange(9)}" for _ in range(i % 4)])) for i in range(400)]
    texts += [(f"o{i:04d}", " ".join(f"w{rng.randrange(500)}" for _ in range(6))) for i in range(800)]
    roster = [(rng.choice(["train", "train", "dev", "test"]), q) for q, _ in texts]
    want = brute(roster, texts, 0.75)
    rows = [(0, 0, n, n % 2 == 0, n % 3 > 0, 3, 0, [1, 2, 3]) for n in range(60)]
    array = spark.createDataFrame(rows, "part int, interval bigint, set_id bigint, in_eval boolean, in_train boolean, size int, start int, suffix array<bigint>")
    met = sorted((r.x, r.y) for r in overlap.shared_spans(array, 0.75, block=7).collect())
    assert met == sorted((x, y) for x in range(0, 60, 2) for y in range(60) if y % 3)
    monkeypatch.setattr(overlap.shared_spans, "__defaults__", (16,))
    assert run(spark, roster, texts) == want
