import random
import re

import numpy as np
import pytest

from corpuslens.llm import neardup
from corpuslens.llm.shingles import shingle_hashes, unique_per_text, word_hashes

SCHEMA = "id string, content string, class string, fp string, n int"
WORD = re.compile(r"[^\W_]+")


def grams(text, p):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + p.shingle]) for i in range(len(w) - p.shingle + 1)} if len(w) >= max(p.least_words, p.shingle) else set()


def brute(rows, p):
    sets = [(i, grams(t, p)) for i, t in rows]
    sets = [(i, s) for i, s in sets if s]
    return {(min(a, b), max(a, b)) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a != b and len(s & t) >= p.similarity * len(s | t)}


def run(spark, rows, p):
    members, links = neardup.near_duplicates(spark.createDataFrame([(i, t, "c", "f", 1) for i, t in rows], SCHEMA), p)
    got = [(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links, p).collect()]
    assert len(got) == len(set(got))
    return set(got), members, links


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.__setitem__(k, f"e{rng.randrange(10**6)}"), lambda: w.insert(k, f"i{rng.randrange(10**6)}"), lambda: w.pop(k)])()
    return " ".join(w)


@pytest.mark.parametrize("p", [neardup.NearDup(3, 0.5, 20), neardup.NearDup()])
def test_against_brute_force(spark, p):
    rng = random.Random(1)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(25, 120))]
        rows += [(f"{g}-{k}", edited(rng, base, rng.randrange(0, 9))) for k in range(4)]
    rows += [("u1", rows[0][1].upper().replace(" ", " , ")), ("n", None), ("e", ""), ("b", " \n"), ("s", "too short"), ("long", "word " * 30_000), ("long2", "word " * 29_000)]
    rows += [rows[5], rows[5]]  # repeated rows
    want = brute(rows, p)
    got, _, _ = run(spark, rows, p)
    assert got <= want
    assert len(got) >= 0.99 * len(want) and ("long", "long2") in got


def test_copies_are_one_class(spark):
    p = neardup.NearDup(3, 0.5, 20, block=8)
    base = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:03d}", " ".join(base)) for i in range(50)] + [("z", " ".join(base[:-1] + ["other"])), ("t1", "x " * 25), ("t2", "X. " * 25)]
    got, members, links = run(spark, rows, p)
    assert members.select("n").distinct().count() == 3 and links.count() == 1
    assert got == {(f"c{i:03d}", f"c{k:03d}") for k in range(50) for i in range(k)} | {(f"c{i:03d}", "z") for i in range(50)} | {("t1", "t2")}
    groups = {r.id: (r.group_id, r.n_links) for r in neardup.groups(members, links).collect()}
    assert groups["z"] == ("c000", 1) and groups["c049"] == ("c000", 1) and groups["t2"] == ("t1", 0) and len(groups) == 53


def test_a_hot_copy_does_not_hide_its_variants(spark):
    p = neardup.NearDup(3, 0.5, 20, common_least=100)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    variants = [(f"v{k:02d}", edited(rng, base, 6)) for k in range(30)]
    rows = [(f"c{i:04d}", " ".join(base)) for i in range(1500)] + variants + [(f"o{i}", " ".join(f"o{rng.randrange(9000)}" for _ in range(40))) for i in range(1500)]
    got, _, _ = run(spark, rows, p)
    assert {("c0000", v) for v, _ in variants} <= got
    assert brute(variants, p) <= got


def test_components_of_a_chain(spark):
    members = spark.createDataFrame([(f"r{i:02d}", i) for i in range(30)], "id string, n bigint")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 19)] + [(25, 27), (26, 27)], "a bigint, b bigint")
    got = {r.id: r.group_id for r in neardup.groups(members, links).collect()}
    assert all(got[f"r{i:02d}"] == "r00" for i in range(20)) and got["r27"] == "r25" and got["r22"] == "r22"


def test_empty_tables(spark):
    for rows in ([], [("a", None)], [("a", "few words")]):
        got, members, links = run(spark, rows, neardup.NearDup())
        assert got == set() and members.count() == 0 and links.count() == 0


def test_the_last_row_of_a_history_counts(spark):
    p = neardup.NearDup(3, 0.5, 5)
    old, new = "one two three four five six seven", "alpha beta gamma delta epsilon zeta"
    rows = [("a", 1, False, old), ("a", 3, False, new), ("a", 3, False, new), ("b", 1, False, new), ("b", 2, True, new), (None, 1, False, new), ("c", 1, True, new), ("d", None, None, new), ("e", 2, False, old), ("f", 2, False, old), ("g", 1, False, new), ("g", 2, False, "short")]
    df = spark.createDataFrame(rows, "k string, at int, gone boolean, v string").selectExpr("k", "timestamp_seconds(at) AS at", "gone", "v")
    members, links = neardup.near_duplicates(neardup.history(df, "k", "at", "gone", df["v"]), p)
    got = {(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links, p).collect()}
    assert got == {("a", "d"), ("e", "f")} and sorted(r.id for r in members.collect()) == ["a", "d", "e", "f"]


def test_word_and_shingle_hashes():
    texts = ["", "Ein Wort", "ein_wort EIN", "a-b a b", "x", "日本 語 é", "a b a b a b"]
    h, n = word_hashes(texts)
    assert n.tolist() == [len(WORD.findall(t.lower())) for t in texts]
    words = [w for t in texts for w in WORD.findall(t.lower())]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    s, m = shingle_hashes(h, n, 2)
    assert m.tolist() == [max(0, k - 1) for k in n.tolist()]
    assert len(unique_per_text(s, m)[0]) == sum(len({tuple(w[i : i + 2]) for i in range(len(w) - 1)}) for w in (WORD.findall(t.lower()) for t in texts))
    assert np.array_equal(word_hashes(["pad pad", *texts])[0][2:], h)  # wherever a word stands


@pytest.mark.parametrize("length,edits", [(42, 1), (102, 2)])
def test_large_group_of_edited_records(spark, length, edits):
    """A third of all rows, each with rare words of its own: the group's words are common, its edits are not."""
    rng = random.Random(6)
    p = neardup.NearDup(3, 0.5, 20, block=256, common_least=100)
    base = [f"g{i}" for i in range(length)]
    planted = []
    for k in range(600):
        w = list(base)
        for e, at in enumerate(rng.sample(range(length), edits)):
            w[at] = f"rare{k}x{e}"
        planted.append((f"p{k:04d}", " ".join(w)))
    others = [(f"o{k:04d}", " ".join(f"w{rng.randrange(3000)}" for _ in range(40))) for k in range(1200)]
    want = brute(planted, p)
    got, _, _ = run(spark, planted + others, p)
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("size,others", [(1500, 8000)])
def test_large_family(spark, size, others):
    """A family whose own shingles are common, with up to eight edits each, beside unrelated records."""
    rng = random.Random(9)
    p = neardup.NearDup(3, 0.5, 20)
    base = [f"w{rng.randrange(3000)}" for _ in range(80)]
    rows = [(f"p{k:05d}", edited(rng, base, rng.randrange(0, 9))) for k in range(size)]
    want = brute(rows, p)
    rows += [(f"o{k:05d}", " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(25, 120)))) for k in range(others)]
    got, _, _ = run(spark, rows, p)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_common_words_in_rare_order(spark):
    """Records of everyday words that differ in a few rare names are found: what counts is how common whole shingles are."""
    rng = random.Random(10)
    p = neardup.NearDup(3, 0.5, 20, common_least=100)
    everyday = [f"w{i}" for i in range(150)]
    rows = []
    for g in range(1000):
        base = [rng.choice(everyday) for _ in range(60)]
        for k in range(2):
            w = list(base)
            for at in (10, 30, 50):
                w[at] = f"name{g}x{k}x{at}"
            rows.append((f"{g:04d}-{k}", " ".join(w)))
    got, _, _ = run(spark, rows, p)
    assert got == {(f"{g:04d}-0", f"{g:04d}-1") for g in range(1000)}


@pytest.mark.parametrize("sizes", [[1, 2, 64, 65, 3, 700, 1], [300], [65, 65], [1]])
def test_meetings_stream_over_batches(sizes):
    """Keys of any number of classes, cut into batches anywhere, give each pair or each hot class once."""
    import pyarrow as pa

    p = neardup.NearDup(block=8)
    rows = [(k, 1000 * k + i) for k, size in enumerate(sizes) for i in range(size)]
    for step in (1, 7, 64, 10_000):
        batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in rows[i : i + step]], "n": [r[1] for r in rows[i : i + step]]}) for i in range(0, len(rows), step)]
        out = [r for b in neardup._meetings(p)(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["a"], r["key"]) for r in out if r["b"] is None) == [(n, k) for k, n in rows if sizes[k] > p.small_key]
        met = sorted((r["a"], r["b"]) for r in out if r["b"] is not None)
        assert met == sorted((a, b) for k, a in rows for j, b in rows if k == j and a < b and sizes[k] <= p.small_key)


def test_a_large_family_covers_itself():
    """Of a large family few records count, of unrelated ones nearly all."""
    from corpuslens.llm.shingles import shingle_hashes, unique_per_text, word_hashes

    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(80)]
    family = [edited(rng, base, rng.randrange(0, 9)) for _ in range(3000)]
    others = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(25, 120))) for _ in range(1000)]
    covered = neardup._covered(*unique_per_text(*shingle_hashes(*word_hashes(family + others + [""]), 3)))
    assert (~covered[:3000]).sum() <= 10 and covered[3000:4000].mean() < 0.01 and covered[4000]
    assert neardup._covered(np.zeros(0, np.uint64), np.zeros(1, np.int64)).tolist() == [True]
