import random

import pytest

from corpuslens.llm import encode, mixture

TOKENIZER = encode.Tokenizer.public()
PIECES = ["word", " ", "  ", "\n", "\t \n", "don't", "'s", "'", "12", "3.5", "é", "日本語", "。", "，", "--", "_", " ", "\x1c", "​", "👩‍⚕️", "<|endoftext|>", "A" * 50, "Ω", "½", "́", "x", "...", "\r\n", " a", " 1"]


def texts(seed, n):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(PIECES) for _ in range(200)) for _ in range(5)]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 300)))
        out.append(t + rng.choice(stock) + rng.choice(["", t[::-1]]))
    return out


def expected(t):
    return TOKENIZER.load()[0].encode_ordinary(t) if t else []


def test_chunks_rejoin_and_depend_on_content_only():
    ts = [*texts(0, 30), "x" * 20_000]
    number, ends = encode.chunk_texts(ts)
    assert [int(e) for i, e in zip(number, ends) if i == 30][-1] == 20_000
    whole = ts[3] * 3
    _, alone = encode.chunk_texts([whole])
    _, moved = encode.chunk_texts(["some words in front, " + whole])
    shift = len("some words in front, ")
    assert len(set(alone) & {int(m) - shift for m in moved}) >= len(alone) - 1


def test_certain_starts_are_those_of_the_single_rule():
    import numpy as np

    joined = "".join(texts(3, 40)) + "".join(chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    got = encode._certain_starts(points[:-1], points[1:])
    assert got.tolist() == [encode._certain(a, b) for a, b in zip(joined, joined[1:])]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_at_certain_starts_need_no_repair(seed):
    enc, _ = TOKENIZER.load()
    ts = [t for t in texts(20 + seed, 60) if t]
    number, ends, sure = encode._chunks(ts)
    begin, tokens = 0, {}
    for k, (i, e) in enumerate(zip(number.tolist(), ends.tolist())):
        begin = 0 if k == 0 or number[k - 1] != i else begin
        tokens.setdefault(i, []).extend(enc.encode_ordinary(ts[i][begin:e]))
        begin = e
    assert all(tokens[i] == enc.encode_ordinary(t) for i, t in enumerate(ts)) and sure.all() and len(ends) > 2 * len(ts)


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_is_repaired_exactly(seed):
    rng = random.Random(seed)
    enc, sizes = TOKENIZER.load()
    import numpy as np

    for t in texts(seed, 40):
        if len(t) < 3:
            continue
        cuts = sorted({0, len(t), *[rng.randrange(1, len(t)) for _ in range(rng.randrange(1, 12))]})
        chunks = [t[a:b] for a, b in zip(cuts, cuts[1:])]
        tokens = [np.asarray(enc.encode_ordinary(c), np.int64) for c in chunks]
        assert encode.join_chunks(tokens, enc, sizes).tolist() == enc.encode_ordinary(t)


def test_corpus(spark):
    ts = [*texts(9, 120), None, "", " ", "x" * 9000, "日本語" * 3000, "<|endoftext|>", "same text", "same text"]
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in enumerate(ts)], "doc_id bigint, text string, seq int, chunk string")
    got = {r.doc_id: list(r.ids) for r in encode.encode_corpus(df, "doc_id", "text", TOKENIZER).collect()}
    assert got == {i: expected(t) for i, t in enumerate(ts)}
    assert encode.encode_corpus(df.limit(0), "doc_id", "text", TOKENIZER).count() == 0


DOCS = "doc_id bigint, text string, source string, rate double"
TARGETS = "source string, weight double, max_repeats int"


def mixed(spark, docs, targets, **more):
    d = spark.createDataFrame([(i, t, s, 1.0) for i, (t, s) in enumerate(docs)], DOCS)
    selection, rates = mixture.mix(d, spark.createDataFrame(targets, TARGETS), TOKENIZER, **more)
    return selection.collect(), {r.source: r for r in mixture.share_report(selection, rates).collect()}


def test_shares_and_repeats(spark):
    rng = random.Random(4)
    docs = [(" ".join("word" for _ in range(rng.randrange(1, 60))), rng.choice(["big", "BIG ", "big", "big", "small", " Mid", "mid", "unlisted", None, ""])) for _ in range(3000)]
    docs += [("", "big"), (None, "big")]
    rows, shares = mixed(spark, docs, [("big", 0.4, 2), ("Small ", 0.3, 4), ("mid", 0.2, 4), ("none", 0.1, 3), (None, 0.5, 1), ("mid", 0.2, 4)])
    for s, w in (("big", 4 / 9), ("small", 3 / 9), ("mid", 2 / 9)):
        assert shares[s].share == pytest.approx(w, abs=0.01)
        assert shares[s].most_copies <= shares[s].max_repeats
    assert shares["none"].share == 0 and set(shares) == {"big", "small", "mid", "none"}
    assert len({r.key for r in rows}) == len(rows) and all(r.copies > 0 for r in rows)
    again, _ = mixed(spark, docs, [("big", 0.4, 2), ("Small ", 0.3, 4), ("mid", 0.2, 4), ("none", 0.1, 3)])
    assert sorted(rows) == sorted(again)  # the same seed, the same mix


def test_total_fills_up_capped_sources(spark):
    docs = [("word " * 10, "big")] * 400 + [("word " * 10, "small")] * 10
    n = mixed(spark, docs, [("big", 0.5, 3), ("small", 0.5, 2)])[1]["small"].n_tokens // 10
    rows, shares = mixed(spark, docs, [("big", 0.5, 3), ("small", 0.5, 2)], total=n * 400)
    assert shares["small"].tokens_used == 20 * n and shares["big"].tokens_used == pytest.approx(380 * n, rel=0.01)
    rows, shares = mixed(spark, docs, [("big", 0.5, 3), ("small", 0.5, 2)], total=10**9)
    assert {r.copies for r in rows} == {2, 3} and shares["big"].docs_used == 400


def test_mix_of_nothing(spark):
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == []
    assert mixed(spark, [("x", "a")], [])[0] == []
    assert mixed(spark, [("x", "a")], [("a", 0.0, 1), ("a", None, 2)])[0] == []
