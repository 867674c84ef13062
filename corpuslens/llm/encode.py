"""Encoding a corpus with a public tokenizer, each distinct content-defined chunk only once.

Texts are cut where a rolling hash of the last few characters has a certain value and the tokenizer certainly starts a new
piece, so that the same passage is cut the same way in whatever text it stands, and its tokens are the same there. The
distinct chunks of all texts are encoded once and joined back. Where a text had to be cut elsewhere (long strings without
any such place), the join is repaired: around it the text is encoded again, from one certain start of a piece to the
next, and takes the place of the chunks' tokens there.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shingles import _powers, mix


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary (ranks file) and its pattern of pieces; the file is read in place by each worker."""

    path: str
    pattern: str

    @staticmethod
    def public(name: str = "byte_bpe_50k.tiktoken") -> Tokenizer:
        import public_tokenizers

        return Tokenizer(str(public_tokenizers.path(name)), public_tokenizers.PATTERN)

    def load(self):
        """(encoding, bytes of each token), kept for the life of the worker."""
        if self.path not in _LOADED:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                sizes[rank] = len(token)
            _LOADED[self.path] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), sizes
        return _LOADED[self.path]


_LOADED: dict = {}

#: Characters that a cut depends on; of about STARTS characters one starts a piece, and of AVERAGE one is a cut.
WINDOW, STARTS, AVERAGE, LONGEST = 12, 5, 128, 4096


def chunk_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, end) of every chunk."""
    return _chunks(texts)[:2]


def _chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, end, whether a new piece certainly starts there) of every chunk: an end where the rolling hash of the
    last WINDOW characters says so and a piece certainly starts, after LONGEST characters, and at a text's end."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    stops = np.cumsum(lengths)
    up, down = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    certain = np.ones(len(points) + 1, bool)
    certain[1:-1] = _certain_starts(points[:-1], points[1:])
    is_end = np.zeros(len(points) + 1, bool)
    if len(points) > WINDOW:
        rolling = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(sums) - WINDOW])
        is_end[WINDOW:] = (rolling % np.uint64(AVERAGE // STARTS) == 0) & certain[WINDOW:]
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts = stops - lengths
    place = np.arange(len(points)) - starts[owner]
    is_end[:-1][place < WINDOW] = False  # a window must lie within its text: position k ends the characters before it
    is_end[:-1][(place > 0) & (place % LONGEST == 0)] = True
    is_end[stops[lengths > 0]] = certain[stops[lengths > 0]] = True
    is_end[0] = False
    ends = np.flatnonzero(is_end)
    number = np.searchsorted(stops, ends, side="left")
    return number, ends - starts[number], certain[ends]


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its class's letter (as a number) and whether it is white space."""
    every = [chr(c) for c in range(0x110000)]
    return np.array([ord(unicodedata.category(c)[0]) for c in every], np.uint8), np.array([c.isspace() for c in every])


def _certain_starts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """`_certain` for code points."""
    kind, space = _kinds()
    a, b = kind[before], kind[after]
    letter, number = a == ord("L"), a == ord("N")
    ends = np.isin(after, [ord(c) for c in _SPACES]) & (letter | number | (a == ord("P")) | (a == ord("S")))
    ascii_ = (before < 128) & (after < 128)
    parts = ascii_ & (letter | number) & ((b == ord("P")) | (b == ord("N"))) & ~(number & (b == ord("N")))
    stops = ~ascii_ & letter & np.isin(after, [ord(c) for c in _CJK_STOPS])
    return ~space[before] & np.where(np.isin(after, [ord(c) for c in _SPACES]), ends, parts | stops)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = [t or "" for t in part.column("text").to_pylist()]
            if not any(texts):
                continue
            number, ends, sure = _chunks(texts)
            chunks, seq = [], []
            before, begin, n = -1, 0, 0
            for i, e in zip(number.tolist(), ends.tolist(), strict=True):
                if i != before:
                    before, begin, n = i, 0, 0
                chunks.append(texts[i][begin:e])
                seq.append(n)
                begin, n = e, n + 1
            keys = part.column("key").take(pa.array(number))
            yield pa.RecordBatch.from_arrays([keys, pa.array(seq, pa.int32()), pa.array(sure), pa.array(chunks, pa.string())], names=["key", "seq", "sure", "chunk"])


#: White space and CJK punctuation whose class no version of Unicode changed.
_SPACES, _CJK_STOPS = frozenset(" \n\t\r\u00a0\u3000"), frozenset("\u3002\uff0c\u3001\uff1b\uff1a\uff1f\uff01")


def _certain(before: str, after: str) -> bool:
    """Whether the pattern starts a new piece between two characters, whatever stands around them.

    Pieces are runs of letters, of digits, or of other characters, each with at most one space before it, and runs of
    white space. So a piece ends where white space follows another character, and where a run of letters or of digits ends.
    """
    if before.isspace():
        return False
    a = unicodedata.category(before)[0]
    if after in _SPACES:
        return a in "LNPS"
    if before.isascii() and after.isascii():
        return a in "LN" and unicodedata.category(after)[0] in "PN" and not (a == "N" and after.isdigit())
    return a == "L" and after in _CJK_STOPS


def join_chunks(tokens: list[np.ndarray], encoding, sizes: np.ndarray, sure: np.ndarray | None = None) -> np.ndarray:
    """The tokens of a whole text from those of its chunks, in order: every join is repaired until it is exact, but for
    those that are exact as a piece certainly starts there (`sure`, for the end of each chunk).

    The tokens spell the text. A stretch between two certain piece starts is encoded again wherever a chunk ends within
    it; a text without any such place is encoded as a whole.
    """
    flat = np.concatenate(tokens)
    if len(tokens) == 1:
        return flat
    data = encoding.decode_bytes(flat.tolist())
    text = data.decode()
    ends = np.cumsum(sizes[flat])  # of each token, in bytes
    joins = ends[np.cumsum([len(t) for t in tokens])[:-1] - 1]
    if sure is not None:
        joins = joins[~sure[:-1]]
    plain = len(text) == len(data)
    if not plain:
        is_start = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        joins = np.concatenate([[0], np.cumsum(is_start)])[joins]
        byte_of = np.append(np.flatnonzero(is_start), len(data))
    stretches: list[tuple[int, int]] = []
    floor = 0
    for j in joins.tolist():
        if stretches and j <= floor:
            continue
        s = e = j
        while s > floor and not _certain(text[s - 1], text[s]):
            s -= 1
        while e < len(text) and not _certain(text[e - 1], text[e]):
            e += 1
        if e > s:
            stretches.append((s, e))
            floor = e
    if not stretches:
        return flat
    # a certain piece start within a chunk is one in the chunk's own tokens too, so that tokens end there
    edges = np.array(stretches) if plain else byte_of[np.array(stretches)]
    first, last = np.searchsorted(ends, edges[:, 0], side="right"), np.searchsorted(ends, edges[:, 1], side="right")
    out, done = [], 0
    for (s, e), a, b in zip(stretches, first.tolist(), last.tolist(), strict=True):
        out += [flat[done:a], np.asarray(encoding.encode_ordinary(text[s:e]), flat.dtype)]
        done = b
    return np.concatenate([*out, flat[done:]])


def _width(sizes: np.ndarray) -> str:
    """How tokens are packed: in two bytes if the vocabulary allows it."""
    return "<u2" if len(sizes) <= 1 << 16 else "<u4"


def encode_corpus(documents: DataFrame, key: str, text: str, tokenizer: Tokenizer) -> DataFrame:
    """key, ids: the token ids of every text, without special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text. Keys must be
    unique and not null. Texts of any length are encoded as a whole: a document's chunks, not its group, meet in a task. A chunk that
    stands in a third of all documents is encoded once; its tokens go back to the documents by a join that adaptive
    execution splits when it is skewed.
    """
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["key"]
    chunks = docs.where(F.length("text") > 0).mapInArrow(_cut, f"key {kind}, seq int, sure boolean, chunk string")
    chunks = chunks.select("key", "seq", "sure", "chunk", F.xxhash64("chunk").alias("h1"), F.xxhash64("chunk", F.lit(1)).alias("h2"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = tokenizer.load()
        for batch in batches:
            ids = [np.asarray(encoding.encode_ordinary(c), _width(sizes)).tobytes() for c in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(ids, pa.binary())], names=["h1", "h2", "tokens"])

    # a chunk's text is moved once, to be encoded; 128 bits of hash stand for it from then on, and its tokens spell it
    encoded = chunks.select("h1", "h2", "chunk").distinct().mapInArrow(encode, "h1 bigint, h2 bigint, tokens binary")
    placed = chunks.select("key", "seq", "sure", "h1", "h2").join(encoded, ["h1", "h2"])
    parts = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "sure", "tokens"))).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = tokenizer.load()
        for batch in batches:
            lists = batch.column("parts")
            flat, own = lists.flatten(), lists.value_lengths().to_numpy()
            packed, sure = flat.field("tokens"), flat.field("sure").to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(packed.to_pylist()), _width(sizes)).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(pc.binary_length(packed).to_numpy())]) // np.dtype(_width(sizes)).itemsize
            last = np.cumsum(own)
            # only chunks that were cut where no piece certainly starts need another look
            unsure = np.add.reduceat(~sure, last - own) > 0 if len(own) else np.zeros(0, bool)
            ids = []
            for first, end, again in zip((last - own).tolist(), last.tolist(), unsure.tolist(), strict=True):
                if again:
                    ids.append(join_chunks([values[offsets[k] : offsets[k + 1]] for k in range(first, end)], encoding, sizes, sure[first:end]))
                else:
                    ids.append(values[offsets[first] : offsets[end]])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
            whole = pa.array(np.concatenate(ids).astype(np.int32)) if ids else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(ends, whole)], names=["key", "ids"])

    full = parts.mapInArrow(assemble, f"key {kind}, ids array<int>")
    empty = docs.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select("key", F.array().cast("array<int>").alias("ids"))
    return full.unionByName(empty).select(F.col("key").alias(key), "ids")
