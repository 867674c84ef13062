"""Vectorised word and shingle hashing for Arrow batches (used inside Spark tasks).

A word is a longest run of letters and digits of the lower-cased text. All texts of a batch are laid
out in one code point array, so that words, their hashes and the hashes of their shingles come from a
handful of numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _is_word_char() -> np.ndarray:
    """True for each code point that is a letter or a digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for key, factor in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, factor & _MASK, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, words per text)."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lowered = [t.lower() if t else "" for t in texts]
    lengths = np.fromiter((len(t) for t in lowered), np.int64, n)
    # a separator after each text, so that no word crosses texts; lone surrogates cannot occur in UTF-8 columns
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends_of_text = np.cumsum(lengths + 1)
    inside = _is_word_char()[points]
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    upto = np.searchsorted(starts, ends_of_text, side="left")
    return hashes, np.diff(upto, prepend=0)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of `size` successive words within a text, runs per text)."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    last = len(words) - size + 1
    acc = np.zeros(last, np.uint64)
    for k in range(size):
        acc = (acc + words[k : k + last]) * np.uint64(0xD6E8FEB86659FD93)
    per_text = np.maximum(counts - (size - 1), 0)
    first = np.cumsum(counts) - counts
    keep = np.zeros(last, bool)
    kept = per_text > 0
    marks = np.zeros(last + 1, np.int32)
    np.add.at(marks, first[kept], 1)
    np.add.at(marks, first[kept] + per_text[kept], -1)
    keep = np.cumsum(marks[:-1]) > 0
    return mix(acc[keep]), per_text


def unique_per_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending, and their number per text."""
    if not len(values):
        return values, counts
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts))
