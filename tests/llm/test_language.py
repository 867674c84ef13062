from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import language as L

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, seg_no int, claim string"


@pytest.fixture(scope="module")
def samples(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    return L.labelled_text(spark.read.parquet(f"{SF}/lang_samples.parquet"))


def phrases(text, s):
    """Cross-parsing by brute force: a phrase goes on as long as it stands in `text`; a character that doesn't stand
    there ends a phrase and goes with the next."""
    n, match = 1, ""
    for c in s:
        if match + c in text:
            match += c
        else:
            n, match = n + 1, c if c in text else ""
    return n


def test_costs_are_those_of_cross_parsing():
    train = {"a": "abracadabra\nbanana band", "b": "the cat sat\nон там"}
    parser = L.CrossParser.fit(train)
    texts = ["abrabanana", "the band sat", "", "q", "он the", "bananabananabanana", "x" * 50, "qaqb𐀀a"]
    costs = parser.costs(texts)
    for k, lang in enumerate(parser.languages):
        for i, t in enumerate(texts):
            assert costs[i][k] / parser.bits[k] + 1 == pytest.approx(phrases(train[lang], t)), (t, lang)


def test_sentences_are_the_whole_text():
    for t in ("One. Two! 3.5 mg? Yes.\n\nNo", "", "。？", "a。b？c", "x", "e.g. this (cf. that). Done.", "\n \n", "..."):
        assert "".join(L.sentences(t)) == t
    assert L.sentences("Up 3.5 mg. Next one.") == ["Up 3.5 mg.", " Next one."]


@pytest.mark.parametrize("label,code", [("EN", "en"), (" de ", "de"), ("zho", "zh"), ("pt_BR", "pt"), ("zh-Hans", "zh"), ("French", "fr"), ("n/a", None), ("", None), (None, None), ("xx", None), ("und", None), ("unknown", None), ("de-AT", "de")])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "x string").select(L.label_code(F.col("x")).alias("c")).first().c == code


def test_segments_of_documents(spark, samples):
    own = {}
    for r in spark.read.parquet(f"{SF}/lang_samples.parquet").orderBy("sample_id").collect():
        own.setdefault(r.lang, []).append(r.text)
    docs = [(1, " ".join(own["de"][:5])), (2, " ".join(own["en"][:4] + own["it"][:3]) + "\n\n" + " ".join(own["en"][4:7])), (3, own["zh"][0] + own["ru"][0]), (4, None), (5, " \n"), (6, "12 % 3 | 4."), (7, own["es"][3].upper()), (8, own["fr"][0] + " 12. (cf. bla).")]
    docs += [(9, " ".join(own["sv"] * 40)), (10, "<p>" + own["nl"][2] + "</p>"), (10, "<p>" + own["nl"][2] + "</p>")]
    df = spark.createDataFrame([(i, t, "x", 9, "c") for i, t in docs], DOCS)
    rows = L.language_segments(df, "doc_id", "text", samples, "lang").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.seg_no)):
        got.setdefault(r.doc_id, []).append(r.lang)
        assert 0 <= r.confidence <= 1 and r.claim == "x"
    assert got == {1: ["de"], 2: ["en", "it", "en"], 3: ["zh", "ru"], 7: ["es"], 8: ["fr"], 9: ["sv"], 10: ["nl", "nl"]}
    spans = {i: t for i, t in docs}
    for r in rows:
        if r.doc_id == 2 and r.seg_no == 1:
            assert spans[2][r.begin : r.begin + r.length].strip() == " ".join(own["it"][:3])
    assert L.language_segments(df.limit(0), "doc_id", "text", samples, "lang").count() == 0
    assert L.language_segments(df, "doc_id", "text", {}, "lang").count() == 0


def test_held_out_accuracy(spark, samples):
    """The automata are fitted on the samples and on documents with even ids; the others are to agree with their labels,
    of which a few in a hundred are wrong."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = L.extend(samples, L.labelled_documents(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang"))
    rows = L.language_segments(docs.where("doc_id % 2 = 1"), "doc_id", "text", fitted, "lang")
    held = rows.where("n_segments = 1").select("lang", "confidence", L.label_code(F.col("claim")).alias("label")).where("label IS NOT NULL").collect()
    assert len(held) > 300
    assert sum(r.lang == r.label for r in held) >= 0.92 * len(held)
    wrong = [r for r in held if r.lang != r.label]
    assert sum(r.confidence > 0.3 for r in wrong) >= 0.8 * len(wrong)  # they differ clearly: it is the label that is wrong


def test_extension_rejects_wrong_claims(samples):
    more = L.extend(samples, [("es", "Non è ancora chiaro se il beneficio duri nel tempo, e nessuno lo sa davvero."), ("it", "Nessun effetto avverso grave è stato osservato. Chi è contrario sostiene che la misura danneggia i giovani e non risolve niente.")])
    assert "ancora chiaro" not in more["es"]
