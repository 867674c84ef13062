"""Languages of documents and of their stretches, by cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled sentences tells the longest match of any text with them. A sentence
is parsed into phrases, each as long as the automaton can follow; the language in whose automaton it needs the fewest
phrases, in bits for its length, fits best. All sentences of a batch are followed through all automata at once, one
character at a time, by lookups in one flat transition table.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ten languages, with their three-letter codes and English names.
LANGUAGES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "sv": ("swe", "swedish"),
    "ru": ("rus", "russian"),
    "zh": ("zho", "chi", "chinese"),
}

_MARKUP = re.compile(r"<[^<>\n]{1,200}>|https?://\S+|\S+@\S+\.\S+|<\|[a-z_]+\|>|\{?\"[a-z_]+\":")
_DAMAGED = re.compile("[Â-ô][\u0080-¿Œ-™]{1,3}")
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?]+(?=[^\s\"')\]”])[^.!?。！？\n]*)*(?:[.!?。！？]+[\"')\]”]*|\n+|$)")
_LONG = re.compile(r"[^\W_]{31,}")


def label_code(label: Column) -> Column:
    """The language that a label names, however spelled (case, blanks, three letters, region, English name), else null."""
    names = {n: code for code, more in LANGUAGES.items() for n in (code, *more)}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    base = F.regexp_extract(F.lower(F.trim(label)), r"^\s*([a-z]+)\s*(?:[-_].*)?$", 1)
    return F.try_element_at(table, base)


def _repaired(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode()
        except UnicodeError:
            continue
    return m.group()


def sentences(text: str) -> list[str]:
    """The text in sentences: up to a stop with white space behind it, a CJK stop, or a line's end. Together they are
    the whole text."""
    return [s for s in _SENTENCE.findall(text) if s]


def plain(sentence: str) -> str:
    """What a sentence is compared by: lower-case letters, with one blank for anything else. Markup, addresses and
    unbroken letter strings (over 30 letters of a script with word spaces) are dropped, damaged encodings repaired."""
    s = _MARKUP.sub(" ", html.unescape(sentence) if "&" in sentence else sentence)
    s = _DAMAGED.sub(_repaired, s)
    if not s.isascii():
        s = unicodedata.normalize("NFC", s).translate(_INVISIBLE)
    s = _LONG.sub(lambda m: " " if m.group()[0] < "Ԁ" else m.group(), s.lower())
    return " " + " ".join(_LETTERS.findall(s)) + " "


_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF])
_LETTERS = re.compile(r"[^\W\d_]+")


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of each state; state 0 is the start, and every substring of `text` is a path from it."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


@dataclass
class CrossParser:
    """Automata of all languages in one flat table.

    A state is the offset of its row; table[state + code] is the next state, or -1 where no match goes on. codes maps
    a code point to its column in each language's rows, 0 for characters that the language doesn't have.
    """

    languages: list[str]
    table: np.ndarray = field(repr=False)
    roots: np.ndarray
    codes: np.ndarray = field(repr=False)
    bits: np.ndarray  # of a phrase: the choice among the places of the labelled text

    @staticmethod
    def fit(samples: dict[str, str]) -> CrossParser:
        languages = sorted(samples)
        tables, roots, bits, base = [], [], [], 0
        codes = np.zeros((len(languages), 0x10000), np.int32)
        for k, lang in enumerate(languages):
            text = samples[lang]
            edges = suffix_automaton(text)
            alphabet = {c: i + 1 for i, c in enumerate(sorted(set(text) - {"\n"}))}
            for c, i in alphabet.items():
                if ord(c) < 0x10000:
                    codes[k, ord(c)] = i
            width = len(alphabet) + 1
            rows = np.full((len(edges), width), -1, np.int32)
            for state, own in enumerate(edges):
                for c, to in own.items():
                    if c != "\n":
                        rows[state, alphabet[c]] = base + to * width
            tables.append(rows.ravel())
            roots.append(base)
            bits.append(math.log2(max(2, len(text))))
            base += rows.size
        return CrossParser(languages, np.concatenate(tables), np.array(roots, np.int32), codes, np.array(bits))

    def costs(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the bits of each text's phrases in each language.

        A language none of whose letters stand in a text parts it at each of its letters, and is not followed through
        it: so a text in Cyrillic letters is parsed by the automata of such languages only.
        """
        n = len(texts)
        out = np.zeros((n, len(self.languages)))
        if not n:
            return out
        lengths = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        points = np.where(points < 0x10000, points, 0)
        letters = np.concatenate([[0], np.cumsum(points != 0x20)])
        ends = np.cumsum(lengths)
        known = np.concatenate([np.zeros((len(self.languages), 1), np.int64), np.cumsum((self.codes[:, points] > 0) & (points != 0x20), axis=1)], axis=1)
        has = (known[:, ends] - known[:, ends - lengths]).T > 0
        out[:] = (letters[ends] - letters[ends - lengths])[:, None] * self.bits
        which = has @ (1 << np.arange(len(self.languages)))
        for mask in np.unique(which[has.any(axis=1)]):
            own = np.flatnonzero(which == mask)
            some = np.flatnonzero(has[own[0]])
            out[np.ix_(own, some)] = self._followed([texts[i] for i in own], some)
        return out

    def _followed(self, texts: list[str], some: np.ndarray) -> np.ndarray:
        """(texts, the languages `some`): bits, by following every text through the automata."""
        n = len(texts)
        out = np.zeros((n, len(some)))
        codes, roots = self.codes[some], self.roots[some][:, None]
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le"), np.uint32)
        points = np.where(points < 0x10000, points, 0).astype(np.uint16)
        lengths = lengths[order]
        starts = np.cumsum(lengths) - lengths
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
        state = np.repeat(roots, n, axis=1)
        phrases = np.ones((len(some), n), np.int32)
        for t in range(lengths[0]):
            m = active[t]
            column = codes[:, points[starts[:m] + t]]
            to = self.table[state[:, :m] + column]
            parted = to < 0
            phrases[:, :m] += parted
            again = self.table[roots + column]
            state[:, :m] = np.where(parted, np.where(again < 0, roots, again), to)
        out[order] = (phrases - 1).T * self.bits[some]  # a text without letters costs nothing anywhere
        return out


def segments(costs: np.ndarray, switch_bits: float) -> list[int]:
    """The language of each sentence of a text: the cheapest sequence, in which every change costs `switch_bits`.

    Sentences that hardly tell (short ones, numbers, names) thereby go with their neighbours.
    """
    n, k = costs.shape
    total, back = costs[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(total.argmin())
        change = total[best] + switch_bits
        stay = total <= change
        back[i] = np.where(stay, np.arange(k), best)
        total = np.where(stay, total, change) + costs[i]
    path = [int(total.argmin())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return path[::-1]


def labelled_text(samples: DataFrame, chars: int = 200_000) -> dict[str, str]:
    """Per language the labelled sentences, in order of their text, up to `chars` characters of each language.

    `samples` (lang, text) is the classifier's bounded input: what goes to the driver is at most `chars` for each language.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("code").orderBy("text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = samples.select(label_code(F.col("lang")).alias("code"), "text").where("code IS NOT NULL AND length(trim(text)) > 0").distinct()
    rows = known.withColumn("upto", F.sum(F.length("text") + 1).over(w)).where(F.col("upto") <= chars).select("code", "text").collect()
    out: dict[str, list[str]] = {}
    for code, text in sorted(rows):
        out.setdefault(code, []).append(plain(text))
    return {code: "\n".join(texts) for code, texts in out.items()}


def labelled_documents(documents: DataFrame, key: str, text: str, label: str, per_language: int = 300, longest: int = 4000) -> list[tuple[str, str]]:
    """(language, text) of documents that claim a language: at most `per_language` of each, of at most `longest`
    characters, chosen by a hash of their key. Together with `labelled_text` this is all that the classifier is fitted on.
    """
    from pyspark.sql import Window

    known = documents.select(label_code(F.col(label)).alias("code"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("key"))
    known = known.where(F.col("code").isNotNull() & (F.length("text") > 0) & (F.length("text") <= longest))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("h", "key"))
    return sorted((r[0], r[1]) for r in known.withColumn("k", rank).where(F.col("k") <= per_language).select("code", "text").collect())


def extend(samples: dict[str, str], documents: list[tuple[str, str]], chars: int = 40_000, novelty: float = 0.34) -> dict[str, str]:
    """`samples` with sentences of documents that claim a language, up to `chars` characters for each.

    Claims can be wrong, and texts mixed: a document is believed if the samples find its language too, and of it the
    sentences whose word pairs stand more often in the documents of its language than in those of any other. Sentences
    that bring few new word pairs are left out, so that the automata stay small.
    """
    parser = CrossParser.fit(samples)
    split = [(code, [plain(s) for s in sentences(text)]) for code, text in documents if code in samples]
    costs, at, believed = parser.costs([s for _, own in split for s in own]), 0, []
    often: dict[str, dict[str, int]] = {}  # word pair -> language -> sentences
    number: dict[str, int] = {}
    for code, own in split:
        mine, at = costs[at : at + len(own)], at + len(own)
        if own and parser.languages[int(mine.sum(axis=0).argmin())] == code:
            for s in own:
                if len(s) > 20:
                    believed.append((code, s, _pairs(s)))
                    number[code] = number.get(code, 0) + 1
                    for p in believed[-1][2]:
                        of = often.setdefault(p, {})
                        of[code] = of.get(code, 0) + 1
    texts = {lang: [own] for lang, own in samples.items()}
    seen = {lang: {p for line in own.split("\n") for p in _pairs(line)} for lang, own in samples.items()}
    size = {lang: len(own) for lang, own in samples.items()}
    for code, s, pairs in believed:
        if len(pairs - seen[code]) < novelty * len(pairs) or size[code] + len(s) > chars:
            continue
        shares: dict[str, float] = {}
        for p in pairs:
            for lang, n in often[p].items():
                shares[lang] = shares.get(lang, 0.0) + n / number[lang]
        if max(shares, key=lambda lang: (shares[lang], lang)) == code:
            texts[code].append(s)
            size[code] += len(s) + 1
            seen[code] |= pairs
    return {lang: "\n".join(own) for lang, own in texts.items()}


def _pairs(line: str) -> set[str]:
    """Pairs of successive words, of characters in scripts without word spaces."""
    words = line.split()
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} | {w[i : i + 2] for w in words if w[0] > "\u2e80" for i in range(len(w) - 1)}


def language_segments(documents: DataFrame, key: str, text: str, samples: dict[str, str], carry: str, switch_bits: float = 60.0) -> DataFrame:
    """key, claim, seg_no, lang, confidence, begin, length, n_segments: the stretches of each text in one language.

    A segment is a longest run of whole sentences in one language; begin and length are in characters. claim is the column
    `carry` as it stands. confidence is the part of the second-best language's bits that the best one saves over the segment, from 0 to 1. Texts that are
    null, blank or have no letters have no segments. Whole texts are read, of any length; without samples there are none.
    """
    docs = documents.select(F.col(key).alias("key"), F.col(carry).alias("claim"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    schema = f"key {dict(docs.dtypes)['key']}, claim string, seg_no int, lang string, confidence double, begin int, length int, n_segments int"
    if not samples:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    spread = docs.sparkSession.sparkContext.broadcast(samples)  # bounded, see labelled_text
    name = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(name, spread.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 400):
                part = batch.slice(k, 400)
                parts = [sentences(t) if _LETTERS.search(t) else [] for t in part.column("text").to_pylist()]
                costs = parser.costs([plain(s) for own in parts for s in own])
                rows, at = [], 0
                for i, own in enumerate(parts):
                    if own:
                        rows += _rows(i, own, costs[at : at + len(own)], parser.languages, switch_bits)
                        at += len(own)
                if rows:
                    numbers, *columns = zip(*rows, strict=True)
                    kinds = [pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(pa.array(numbers)) for c in ("key", "claim")), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                        names=["key", "claim", "seg_no", "lang", "confidence", "begin", "length", "n_segments"],
                    )

    return docs.mapInArrow(run, schema).withColumnRenamed("key", key)


_PARSERS: dict[str, CrossParser] = {}


def _parser(name: str, samples: dict[str, str]) -> CrossParser:
    """The parser fitted on these samples, kept for the life of the worker; the last one only."""
    if name not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[name] = CrossParser.fit(samples)
    return _PARSERS[name]


def _rows(i: int, own: list[str], costs: np.ndarray, languages: list[str], switch_bits: float) -> list[tuple]:
    path = segments(costs, switch_bits)
    runs: list[list[int]] = []
    for k, lang in enumerate(path):
        if runs and runs[-1][0] == lang:
            runs[-1][2] = k + 1
        else:
            runs.append([lang, k, k + 1])
    out, begin = [], 0
    for n, (lang, first, end) in enumerate(runs):
        bits = costs[first:end].sum(axis=0)
        others = np.delete(bits, lang).min() if len(bits) > 1 else 0.0
        confidence = max(0.0, 1.0 - bits[lang] / others) if others > 0 else 0.0
        length = sum(len(s) for s in own[first:end])
        out.append((i, n, languages[lang], float(confidence), begin, length, len(runs)))
        begin += length
    return out
