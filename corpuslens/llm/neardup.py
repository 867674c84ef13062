"""Near-duplicate records: multi-index hashing over shingle fingerprints, then an exact check of whole groups.

A record's fingerprint is a word of `segments * width` symbols of 16 bits, each the minimum of one hash over the
record's shingles. Two records agree in a symbol with about the probability of their (weighted) similarity, so
near-duplicates have a small Hamming distance, counted in symbols. The fingerprint is cut into segments; for each
segment the small Hamming ball around its value (all patterns in which `radius` symbols may be anything) is
enumerated as table keys. Records that meet in a table have their complete distance computed, and those close enough
are compared exactly, by their sets of shingles.

Shingles that stand in at least `common_share` of all records (and in `common_least`) weigh 1/`common_weight` in the
symbols: phrases that every record has would otherwise fill the tables with chance meetings. Records that resemble
others don't count for that, so that the phrases of a large group of near-duplicates keep their weight; its table keys are
hot and split into blocks. A link is no more than a way into a group, too: the records that are linked, directly or
through others, are compared with each other once more, all of them by their sets. No meeting, partner or group is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shingles import mix, shingle_hashes, unique_per_text, word_hashes
from corpuslens.plans.lineage import cut, discard


@dataclass(frozen=True)
class NearDup:
    """Parameters. `least_agreeing`: symbols in which two fingerprints must agree to be compared exactly."""

    shingle: int = 5
    similarity: float = 0.8
    least_words: int = 5
    segments: int = 14
    width: int = 3
    radius: int = 1
    least_agreeing: int = 5
    common_share: float = 0.003
    common_least: int = 500
    common_weight: int = 64
    small_key: int = 64  # classes of a key up to which they are paired as they stream by; others are split into blocks
    block: int = 512  # classes that are compared with as many others at once
    gathered: int = 100_000  # rows of keys paired at once
    chunk: int = 512  # texts hashed at once, so that the arrays stay in the processor's cache
    counted: int = 16384  # records whose shingles are counted at once
    slack: int = 8  # counts of less than 1 in `slack` of the common share in such a batch are not passed on

    @property
    def symbols(self) -> int:
        return self.segments * self.width


def history(rows: DataFrame, key: str, at: str, gone: str, content: Column) -> DataFrame:
    """id, at, gone, content of a load history, for `near_duplicates`. A null `at` is the earliest; null keys are no records."""
    when = F.coalesce(F.col(at).cast("timestamp_ntz"), F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'"))
    return rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), when.alias("at"), F.coalesce(F.col(gone), F.lit(False)).alias("gone"), content.alias("content")
    )


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = batch.slice(k, size)
            yield part, part.column("content").to_pylist()


def _classes(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 2): a hash of 128 bits of the word sequence of each text; 0 for one without words."""
    first = np.cumsum(counts) - counts
    place = mix((np.arange(len(words)) - np.repeat(first, counts)).astype(np.uint64))
    halves = []
    for each in (mix(words + place), mix(mix(words ^ np.uint64(0x9E3779B97F4A7C15)) + place)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(each)])
        halves.append(sums[first + counts] - sums[first])
    return np.stack(halves, axis=1)


def _packed(classes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(classes), [None, pa.py_buffer(classes.tobytes())]).cast(pa.binary())


def common_shingles(contents: DataFrame, p: NearDup) -> np.ndarray:
    """Hashes of the shingles of at least `common_share` of all records (and `common_least`), ascending.

    Counted over every record, `counted` of them at a time; of these a record is passed over if one before it is nearly
    the same (see `_covered`), so that neither copies nor a large group of near-duplicates make their own words common.
    Counts below 1/`slack` of the share within a batch are not passed on, so that a shingle may lack that much of
    its count: whatever reaches the share in full is in, whatever stays below (1 - 1/slack) of it is not. So there are
    about (mean number of shingles) / common_share of them at most, however many records there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for _, texts in _chunks(batches, p.chunk):
            waiting.append(unique_per_text(*shingle_hashes(*word_hashes(texts), p.shingle)))
            n += len(texts)
            if n >= p.counted:
                yield tally(waiting)
                waiting, n = [], 0
        if n:
            yield tally(waiting)

    def tally(waiting: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        shingles, sizes = (np.concatenate(x) for x in zip(*waiting, strict=True))
        own = ~_covered(shingles, sizes)
        shingles, times = np.unique(shingles[np.repeat(own, sizes)], return_counts=True)
        often = times >= p.common_share * own.sum() / p.slack
        shingles, times = np.append(shingles[often].view(np.int64), 0), np.append(times[often], own.sum())  # 0 stands for the records
        return pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(times, pa.int64())], names=["shingle", "n"])

    counts = contents.select("content").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = cut(counts.where((F.col("n") >= p.common_least * (1 - 1 / p.slack)) | (F.col("shingle") == 0)))
    records = counts.where("shingle = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where((F.col("shingle") != 0) & (F.col("n") >= p.common_share * records * (1 - 1 / p.slack))).select("shingle").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def _covered(shingles: np.ndarray, sizes: np.ndarray, bins: int = 32, width: int = 4, similar: float = 0.35, back: int = 8) -> np.ndarray:
    """Whether a record resembles one before it, of sets of distinct hashes that come ascending.

    The least hash in each of 32 ranges is a sketch of the set. Records whose sketches agree in `width` successive ranges
    are compared by the whole sketch, each with the last `back` before it. Of a group of near-duplicates some ten
    records at most come before the others resemble them, whatever the size of the group. Empty sets count as covered.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = owner * bins + (shingles >> np.uint64(59)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    sketch = np.zeros(len(sizes) * bins, np.uint64)
    sketch[place[first]] = shingles[first]
    sketch = sketch.reshape(-1, bins)
    out = sizes == 0
    for k in range(bins - width + 1):
        key = mix(sketch[:, k : k + width] + np.arange(1, width + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        for step in range(1, min(back, len(key) - 1) + 1):
            later = np.flatnonzero((key[step:] == key[:-step]) & ~out[order[step:]])
            x, y = sketch[order[later]], sketch[order[later + step]]
            agree, either = ((x == y) & (y > 0)).sum(axis=1), ((x > 0) | (y > 0)).sum(axis=1)
            out[order[later + step][agree >= similar * np.maximum(either, 1)]] = True
    return out


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def fingerprints(rows: DataFrame, p: NearDup, common: np.ndarray) -> DataFrame:
    """id, at, gone, class (a hash of 128 bits of the word sequence), fp (packed symbols); both null for rows with fewer than
    `least_words` words, without content, or gone."""
    types = dict(rows.dtypes)
    need = max(p.least_words, p.shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(p.symbols)
        for part, texts in _chunks(batches, p.chunk):
            words, counts = word_hashes(texts)
            long = (counts >= need) & ~part.column("gone").to_numpy(zero_copy_only=False)
            classes, packed = np.zeros((len(texts), 2), np.uint64), np.zeros((len(texts), 2 * p.symbols), np.uint8)
            if long.any():
                words, counts = words[np.repeat(long, counts)], counts[long]
                classes[long] = _classes(words, counts)
                shingles, n = shingle_hashes(words, counts, p.shingle)
                weights = _weights(shingles, common, p)
                starts = np.cumsum(n) - n
                least = np.stack([np.minimum.reduceat(((shingles * m) >> np.uint64(32)) * weights, starts) for m in multipliers], axis=1)
                packed[long] = (mix(least) & np.uint64(0xFFFF)).astype("<u2").view(np.uint8)
            fp = [row.tobytes() if ok else None for row, ok in zip(packed, long.tolist(), strict=True)]
            own = [part.column(c) for c in ("id", "at", "gone")]
            of = pc.if_else(pa.array(long), _packed(classes), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*own, of, pa.array(fp, pa.binary())], names=["id", "at", "gone", "class", "fp"])

    return rows.mapInArrow(run, f"id {types['id']}, at {types['at']}, gone boolean, class binary, fp binary")


def _weights(shingles: np.ndarray, common: np.ndarray, p: NearDup) -> np.ndarray | np.uint64:
    """The factor of each shingle's hashes: `common_weight` for a common one, else 1."""
    if not len(common):
        return np.uint64(1)
    is_common = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    return np.where(is_common, np.uint64(p.common_weight), np.uint64(1))


def _patterns(p: NearDup) -> list[list[int]]:
    """The symbols that each table's key is made of."""
    return [[s * p.width + k for k in kept] for s in range(p.segments) for kept in combinations(range(p.width), p.width - p.radius)]


def _key(symbols: np.ndarray, k: int, kept: list[int]) -> np.ndarray:
    key = np.full(len(symbols), k, np.uint64)
    for s in kept:
        key = (key << np.uint64(16)) | symbols[:, s] if len(kept) <= 3 else mix(key ^ (symbols[:, s] + np.uint64(1)))
    return key.view(np.int64)


def _symbols(packed: pa.Array, p: NearDup) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<u2").reshape(len(packed), p.symbols)


def _ball_keys(p: NearDup):
    """key, n: for each segment, the keys of the Hamming ball of `radius` symbols around its value."""
    patterns = _patterns(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, n = _symbols(batch.column("fp"), p).astype(np.uint64), batch.column("n")
            for k, kept in enumerate(patterns):
                yield pa.RecordBatch.from_arrays([pa.array(_key(symbols, k, kept)), n], names=["key", "n"])

    return run


def _meetings(p: NearDup):
    """a, b for each two classes (a < b) of a key, from rows that come sorted by key; the classes of keys that have more
    than `small_key` come out with their key instead, and b null."""

    def emit(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        null = pa.nulls(len(a), pa.int64())
        columns = [pa.array(a), null if b is None else pa.array(b), null if key is None else pa.array(key)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])

    def pairs(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole keys."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        sizes = np.diff(np.append(np.flatnonzero(new), len(keys)))
        size = np.repeat(sizes, sizes)
        hot = size > p.small_key
        if hot.any():
            yield emit(n[hot], None, keys[hot])
        keys, n = keys[(size > 1) & ~hot], n[(size > 1) & ~hot]
        for step in range(1, p.small_key):
            same = np.flatnonzero(keys[step:] == keys[:-step]) if step < len(keys) else np.empty(0, np.int64)
            if not len(same):
                return
            x, y = n[same], n[same + step]
            yield emit(np.minimum(x, y), np.maximum(x, y), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        spilt = None  # a key of which classes came out before
        for more_keys, more_n in _gathered(batches, ("key", "n"), p.gathered):
            keys, n = np.concatenate([keys, more_keys]), np.concatenate([n, more_n])
            if spilt is not None:
                upto = _run_length(keys == spilt)
                if upto:
                    yield emit(n[:upto], None, keys[:upto])
                keys, n = keys[upto:], n[upto:]
                if not len(keys):
                    continue
                spilt = None
            whole = len(keys) - _run_length(keys[::-1] == keys[-1])  # the last key may go on in the next batch
            if whole:
                yield from pairs(keys[:whole], n[:whole])
                keys, n = keys[whole:], n[whole:]
            if len(keys) > p.small_key:
                spilt = keys[0]
                yield emit(n, None, keys)
                keys, n = keys[:0], n[:0]
        if len(keys):
            yield from pairs(keys, n)

    return run


def _run_length(same: np.ndarray) -> int:
    """How many of the first places are true."""
    return len(same) if same.all() else int(same.argmin())


def _gathered(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of some batches at once, of `rows` rows or more."""
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append([batch.column(c).to_numpy() for c in columns])
        if sum(len(w[0]) for w in waiting) >= rows:
            yield [np.concatenate(c) for c in zip(*waiting, strict=True)]
            waiting = []
    if waiting:
        yield [np.concatenate(c) for c in zip(*waiting, strict=True)]


def _by_group(keys: list[str], run):
    """A function of whole groups, for rows that come sorted by `keys` (integers) in batches."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            place = np.stack([rows.column(k).to_numpy() for k in keys])
            edges = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for first, end in zip([0, *edges.tolist()], edges.tolist(), strict=False):
                yield from run(rows.slice(first, end - first)).to_batches()
            kept = rows.slice(int(edges[-1]) if len(edges) else 0)
        if kept is not None:
            yield from run(kept).to_batches()

    return stream


def candidate_pairs(classes: DataFrame, p: NearDup) -> DataFrame:
    """a, b: classes (a < b) that meet in a table and whose complete fingerprint distance is small enough.

    `classes`: n, fp. A key of up to `small_key` classes gives their pairs as they stream by. A key of more is split
    into blocks, and each two of its blocks are one group of at most about 2 * `block` rows, so that no task holds a
    whole hot key; there, a pair comes out only at the first table in which it meets.
    """
    keys = classes.select("n", "fp").mapInArrow(_ball_keys(p), "key bigint, n bigint").repartition("key").sortWithinPartitions("key")
    met = cut(keys.mapInArrow(_meetings(p), "a bigint, b bigint, key bigint"))
    pairs = met.where("b IS NOT NULL").select("a", "b").distinct()
    fp_a = classes.select(F.col("n").alias("a"), F.col("fp").alias("fp_a"))
    fp_b = classes.select(F.col("n").alias("b"), F.col("fp").alias("fp_b"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agreeing = (_symbols(batch.column("fp_a"), p) == _symbols(batch.column("fp_b"), p)).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(agreeing >= p.least_agreeing))

    few = pairs.join(fp_a, "a").join(fp_b, "b").select("a", "b", "fp_a", "fp_b").mapInArrow(close, "a bigint, b bigint")
    hot = met.where("b IS NULL").select("key", F.col("a").alias("n"))
    sized = hot.join(hot.groupBy("key").agg(F.count("*").alias("size")), "key")
    split = _in_blocks(sized, "n", "size", p.block).join(classes.select("n", "fp"), "n")
    many = split.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_by_group(["key", "i", "j"], _block_pairs(p)), "a bigint, b bigint")
    return few.unionByName(many).distinct()


def _in_blocks(rows: DataFrame, by: str, size: str, block: int) -> DataFrame:
    """`rows` once for every two blocks i <= j of about `block` rows that theirs is one of; own is theirs."""
    blocks = F.ceil(F.col(size) / block)
    split = rows.withColumns({"own": F.pmod(F.xxhash64(by), blocks), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return split.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def _block_pairs(p: NearDup):
    """a, b: the close pairs of two blocks of a key (or of one with itself) that meet in no earlier table."""
    patterns = _patterns(p)

    def run(rows: pa.Table) -> pa.Table:
        key, i, j = (rows.column(c)[0].as_py() for c in ("key", "i", "j"))
        symbols = _symbols(rows.column("fp"), p)
        n, own = rows.column("n").to_numpy(), rows.column("own").to_numpy()
        at = next(k for k, kept in enumerate(patterns) if _key(symbols[:1].astype(np.uint64), k, kept)[0] == key)
        x, y = own == i, own == j
        same = [symbols[x, s][:, None] == symbols[y, s][None, :] for s in range(p.symbols)]
        near = np.zeros((x.sum(), y.sum()), np.uint16)
        for e in same:
            near += e
        near = near >= p.least_agreeing
        for kept in patterns[:at]:
            near &= ~np.logical_and.reduce([same[s] for s in kept])
        u, v = near.nonzero()
        a, b = n[x][u], n[y][v]
        once = a < b if i == j else slice(None)
        return pa.table({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once]})

    return run


#: Bytes of a shingle's hash that sets are compared by: two sets of 1,000 shingles share one by chance once in 10**8 pairs.
GRAM_BYTES = 6


def _shingle_sets(p: NearDup):
    """n, grams: GRAM_BYTES of each distinct shingle's hash, packed; of the texts that are of the class named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches, p.chunk):
            words, counts = word_hashes(texts)
            wanted = np.frombuffer(b"".join(part.column("class").to_pylist()), np.uint64).reshape(-1, 2)
            own = (_classes(words, counts) == wanted).all(axis=1)
            words, counts, part = words[np.repeat(own, counts)], counts[own], part.filter(pa.array(own))
            shingles, n = unique_per_text(*shingle_hashes(words, counts, p.shingle))
            packed = np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]).tobytes()
            ends = (np.cumsum(n) * GRAM_BYTES).tolist()
            grams = [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("n"), pa.array(grams, pa.binary())], names=["n", "grams"])

    return run


def _grams(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all sets in order, numbers per set)."""
    sizes = np.fromiter((len(g) // GRAM_BYTES for g in packed), np.int64, len(packed))
    whole = np.zeros((int(sizes.sum()), 8), np.uint8)
    whole[:, :GRAM_BYTES] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, GRAM_BYTES)
    return whole.view("<u8").ravel(), sizes


def _exact(p: NearDup):
    """a, b, similarity of the pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                tagged, both = [], 0
                for c in ("grams_a", "grams_b"):
                    grams, sizes = _grams(part.column(c).to_pylist())
                    tagged.append((np.repeat(np.arange(part.num_rows, dtype=np.uint64), sizes) << np.uint64(8 * GRAM_BYTES)) | grams)
                    both = both + sizes
                merged = np.sort(np.concatenate(tagged))
                twice = merged[1:][merged[1:] == merged[:-1]] >> np.uint64(8 * GRAM_BYTES)
                shared = np.bincount(twice.astype(np.int64), minlength=part.num_rows)
                similarity = shared / np.maximum(both - shared, 1)
                near = pa.array(similarity >= p.similarity)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similarity)], names=["a", "b", "similarity"]).filter(near)

    return run


def _group_links(p: NearDup):
    """a, b, similarity: the links of two blocks of a group (or of one with itself), each two sets compared."""

    def run(rows: pa.Table) -> pa.Table:
        i, j = (rows.column(c)[0].as_py() for c in ("i", "j"))
        n, own = rows.column("n").to_numpy(), rows.column("own").to_numpy()
        grams, sizes = _grams(rows.column("grams").to_pylist())
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(x) or not len(y):
            return pa.table({"a": n[:0], "b": n[:0], "similarity": np.empty(0)})
        owner = np.repeat(np.arange(len(n)), sizes)
        _, number, times = np.unique(grams, return_inverse=True, return_counts=True)
        owner, number = owner[times[number] > 1], number[times[number] > 1]
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        number = np.cumsum(np.diff(number, prepend=number[:1]) != 0) if len(number) else number
        shared = np.zeros((len(x), len(y)), np.float32)
        width = 2048
        for first in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            lo, hi = np.searchsorted(number, [first, first + width])
            has = np.zeros((len(n), width), np.float32)
            has[owner[lo:hi], number[lo:hi] - first] = 1
            shared += has[x] @ has[y].T
        similarity = shared.astype(np.float64) / (sizes[x][:, None] + sizes[y][None, :] - shared.astype(np.float64))
        u, v = (similarity >= p.similarity).nonzero()
        a, b, value = n[x][u], n[y][v], similarity[u, v]
        once = a < b if i == j else slice(None)
        return pa.table({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once], "similarity": value[once]})

    return run


def near_duplicates(records: DataFrame, p: NearDup) -> tuple[DataFrame, DataFrame]:
    """(members, links) of `records` (id, content; in a load history also at, gone, see `history`).

    members: id, n for every record with enough words; records with the same word sequence share the class n.
    links: a, b, similarity for each pair of classes (a < b) whose sets of shingles have at least the similarity.

    Of an id's rows the last by `at` counts; of rows with the same `at` a deletion, else the one of the greatest class.
    Null, empty and short contents are no members. Exact copies are one class, so that a group of copies with a
    third of all rows meets itself only once. An empty table gives empty tables. Texts are read in place three times,
    and shuffled once, with the ids of those that are to be compared exactly.
    """
    if "at" not in records.columns or "gone" not in records.columns:
        records = records.select("id", F.lit(0).alias("at"), F.lit(False).alias("gone"), "content")
    records = records.select("id", "at", "gone", "content").where("id IS NOT NULL")
    common = common_shingles(records, p)
    state = fingerprints(records, p, common).groupBy("id").agg(F.max(F.struct("at", "gone", "class", "fp")).alias("r"))
    current = cut(state.select("id", "r.*").where("NOT gone AND class IS NOT NULL").select("id", "at", "class", "fp"))
    one = current.groupBy("class").agg(F.min(F.struct("id", "at", "fp")).alias("r"))
    classes = cut(one.select("class", "r.*").withColumn("n", F.monotonically_increasing_id()))
    pairs = cut(candidate_pairs(classes.select("n", "fp"), p))
    involved = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    readers = classes.select("n", "class", "id", "at").join(involved, "n", "left_semi")
    texts = records.where("NOT gone").select("id", "at", "content").join(readers, ["id", "at"]).select("n", "class", "content")
    sets = cut(texts.mapInArrow(_shingle_sets(p), "n bigint, grams binary").dropDuplicates(["n"]))
    both = pairs.join(sets.select(F.col("n").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("n").alias("b"), F.col("grams").alias("grams_b")), "b")
    links = cut(both.select("a", "b", "grams_a", "grams_b").mapInArrow(_exact(p), "a bigint, b bigint, similarity double"))
    return current.select("id", "class").join(classes.select("class", "n"), "class").select("id", "n"), complete(links, sets, p)


def complete(links: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """`links` with those that the tables missed within a group: in a group of which not every two classes are linked,
    every two are compared by their sets, in blocks, so that no task holds a whole group."""
    roots = cut(components(links))
    sized = roots.groupBy("root").agg(F.count("*").alias("size"))
    linked = links.join(roots.withColumnRenamed("n", "a"), "a").groupBy("root").agg(F.count("*").alias("n_links"))
    open_ = sized.join(linked, "root").where(F.col("n_links") < F.col("size") * (F.col("size") - 1) / 2).select("root", "size")
    partial = cut(roots.join(open_, "root"))
    split = _in_blocks(partial, "n", "size", p.block).join(sets, "n").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = split.mapInArrow(_by_group(["root", "i", "j"], _group_links(p)), "a bigint, b bigint, similarity double")
    whole = links.join(partial.select(F.col("n").alias("a")), "a", "left_anti")
    return cut(whole.unionByName(found))


def expand_pairs(members: DataFrame, links: DataFrame, p: NearDup) -> DataFrame:
    """id_a, id_b (id_a < id_b): all pairs of records of linked classes, and all pairs of copies within a class.

    The rows are as many as the pairs, in a class of copies the square of their number; `groups` has a row for each
    record instead. Copies are paired in blocks, so that no task holds a whole class.
    """
    members = cut(members)
    sized = members.groupBy("n").agg(F.count("*").alias("size")).where("size > 1")
    copies = _in_blocks(members.join(sized, "n"), "id", "size", p.block)
    left = copies.where("own = i").select("n", "i", "j", F.col("id").alias("x"))
    right = copies.where("own = j").select("n", "i", "j", F.col("id").alias("y"))
    within = left.join(right, ["n", "i", "j"]).where("i < j OR x < y")
    x, y = members.select(F.col("n").alias("a"), F.col("id").alias("x")), members.select(F.col("n").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(x, "a").join(y, "b")
    return within.select("x", "y").unionByName(across.select("x", "y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """n, root: the classes that belong together, directly or through others, with the least of them; itself too.

    Alternating large-star and small-star steps until nothing changes; each round is a shuffle of the links and is
    written to the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    for _ in range(rounds):
        superseded, edges = edges, cut(_small_star(_large_star(edges)))
        discard(superseded)
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("n"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("n"), F.col("v").alias("root")).distinct())


def groups(members: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, group_id, n_links: each record with the group that it belongs to, directly or through others, named by its
    least id, and the number of links of its class."""
    degree = links.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("n_links"))
    of_class = members.join(components(links, rounds), "n", "left").join(degree, "n", "left").select(
        "id", F.coalesce("root", "n").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    least = of_class.groupBy("root").agg(F.min("id").alias("group_id"))
    return of_class.join(least, "root").select("id", "group_id", "n_links")


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """u, n, m: the neighbours n of each u, and m, the least of u and them."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return edges.join(least, "u").select("u", F.col("v").alias("n"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    return _star(edges, True).where("n > u").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    s = _star(edges, False)
    moved = s.where("n != m").select(F.col("n").alias("u"), F.col("m").alias("v"))
    own = s.where("u != m").select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()
