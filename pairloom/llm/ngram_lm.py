"""An interpolated modified Kneser-Ney n-gram model of any order, counted in Spark and memory-mapped by its workers.

Words are looked up by their 64-bit hash in sorted arrays, one file for each range of hashes, and numbered by falling powers
of two of their counts, so that most numbers sent are small and pack well. Tasks count n-grams of word numbers and send them, sorted and packed, to parts by the hash of the words before the last; a context
that may be frequent is dealt by its last word too, so no part depends on one context. Each part becomes a sorted array
of 64-bit hashes of n-grams beside their counts, written range by range of hashes. What it says of n-grams one word
shorter (occurrences as a context, continuations, words before) goes to the parts of the next order down, and at last to
blocks of word numbers. Scoring tasks map these files and look up what a batch of texts needs part by part, so neither
the driver nor a worker holds the model in memory.

Two n-grams whose 64-bit hashes are equal count as one. Of a hash, files keep 40 bits besides those that its place tells, so a
lookup of an unseen n-gram goes wrong once in 10**10. A text begins with order - 1 marks, and n-grams that begin with one keep their occurrences where others
count the words before them.

A null or empty text is the end token alone. Repeated rows count and are scored each by itself; other columns are
ignored. Words not seen in training share one probability. Without training texts every text scores as a uniform model.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared_files import Appender, load, save
from pairloom.llm.words import mixed, slices, utf8
from pairloom.sources.tables import shared_dir, written

END = b" end"  # no word holds a space


#: Longer words are hashed one by one.
_LONG = 64
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _hashed(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of raw, by its size and its bytes, eight at a time; raw ends with eight bytes more."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    out = mixed(sizes.astype(np.uint64) + _SEED)
    left = np.flatnonzero(sizes <= _LONG)
    for at in range(0, _LONG, 8):
        left = left[sizes[left] > at]
        if not len(left):
            break
        over = np.uint64(8) * np.maximum(0, at + 8 - sizes[left]).astype(np.uint64)
        piece = eight[starts[left] + at] & (np.uint64(2**64 - 1) >> over)
        out[left] = mixed(out[left] * _SEED + piece)
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : starts[k] + sizes[k]], digest_size=8).digest(), "little")
    return out


def hashed_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each token's place among them, and each text's number of tokens."""
    raw = b" " + b"".join(t + b" " for t in texts).lower() + b" " * 8
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    hashes = _hashed(raw, starts, ends - starts)
    closed = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]) + 1) if texts else np.zeros(0, np.int64)
    codes, unique = pd.factorize(np.insert(hashes, closed, _END))
    return unique, codes, np.diff(closed, prepend=0) + 1


_END = _hashed(END + b" " * 8, np.array([0]), np.array([len(END)]))[0]


def _order(keys: np.ndarray) -> np.ndarray:
    """np.argsort(keys, kind="stable") of numbers without sign: places ride in the low bits of one plain sort, which is several
    times faster; keys that differ only in bits left out for that are put right after."""
    if not len(keys):
        return np.zeros(0, np.int64)
    bits = (len(keys) - 1).bit_length()
    shift = max(0, int(keys.max()).bit_length() + bits - 64)
    packed = (keys.astype(np.uint64) >> np.uint64(shift)) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64(2**bits - 1)).astype(np.int64)
    found = keys[order]
    return order[np.argsort(found, kind="stable")] if shift and (found[1:] < found[:-1]).any() else order


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts."""
    order = _order(keys)
    keys, counts = keys[order], counts[order]
    first = _firsts(keys)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


class Tally:
    """Counts by 64-bit key; merges what has come in before it grows past `room` entries."""

    def __init__(self, room: int = 2_000_000):
        self.room, self.parts, self.size = room, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.room:
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.counts), *self.parts]
        self.keys, self.counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self.parts, self.size = [], 0


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally(500_000)
    for b in slices(batches):
        hashes, codes, _ = hashed_tokens(utf8(b.column(0)))
        tally.add(hashes, np.bincount(codes, minlength=len(hashes)))
    tally.merge()
    for at in range(0, len(tally.keys), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(tally.keys[at : at + 50_000].view(np.int64)), pa.array(tally.counts[at : at + 50_000])], ["hash", "n"])


_CLASSES = 64


def _class_of(counts: np.ndarray) -> np.ndarray:
    """The power of two below each count."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64) - 1


@dataclass(frozen=True)
class Vocabulary:
    """sizes: words in each range of hashes; bits: how many leading bits name the range; classes: for each range, the words
    by the power of two of their counts."""

    folder: str
    bits: int
    sizes: tuple[int, ...]
    tokens: int
    classes: tuple[tuple[int, ...], ...] = ()

    @property
    def words(self) -> int:
        return sum(self.sizes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's word number and count; -1 and 0 for words that training hasn't seen."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = _order(hashes)
        ordered = hashes[order]
        falling = np.array(self.classes, np.int64).T[::-1]  # numbers go by class, the highest first, then by range
        starts = (np.cumsum(falling) - falling.ravel()).reshape(falling.shape)[::-1]
        cuts = np.searchsorted(ordered, np.arange(len(self.sizes), dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.array([0])
        for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ordered)], strict=True)):
            if a == b or not self.sizes[r]:
                continue
            keys, n = load(self.folder, f"words-{r}", "uint64"), load(self.folder, f"counts-{r}", "int64")
            at = np.minimum(np.searchsorted(keys, ordered[a:b]), len(keys) - 1)
            ok = keys[at] == ordered[a:b]
            counts[order[a:b][ok]] = n[at[ok]]
            ids[order[a:b][ok]] = starts[_class_of(n[at[ok]]), r] + load(self.folder, f"ranks-{r}", "uint32")[at[ok]]
        return ids, counts


def _grouped(batches: Iterator[pa.RecordBatch], columns: int = 1) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """Runs of rows of equal first columns; the rows must come in their order."""
    held, name = [], None
    for b in batches:
        ids = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(columns)], 1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)] if len(ids) else [0]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if name is not None and tuple(ids[x].tolist()) != name:
                yield name, held
                held = []
            name = tuple(ids[x].tolist())
            held.append(b.slice(x, y - x))
    if held:
        yield name, held


def vocabulary(texts: DataFrame, folder: str, a_file: int = 500_000) -> Vocabulary:
    """Counts the tokens of texts (text) and writes them in files of about a_file words."""
    counted = written(texts.mapInArrow(_unigrams, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "unigrams")
    words, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, words) / a_file))))
    ranges = 2**bits

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (r,), held in _grouped(batches):
            hashes, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (1, 2))
            order = _order(hashes.view(np.uint64))
            save(folder, f"words-{r}", hashes.view(np.uint64)[order])
            save(folder, f"counts-{r}", n[order])
            classes = _class_of(n[order])
            sizes = np.bincount(classes, minlength=_CLASSES)
            by = _order(classes.astype(np.uint64))
            ranks = np.zeros(len(n), np.uint32)
            ranks[by] = np.arange(len(n)) - (np.cumsum(sizes) - sizes)[classes[by]]
            save(folder, f"ranks-{r}", ranks)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([sizes.tolist()], pa.list_(pa.int64()))], ["range", "words"])

    leading = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = counted.select(leading.alias("range"), "hash", "n").repartition(ranges, "range").sortWithinPartitions("range")
    found = {r.range: tuple(r.words) for r in dealt.mapInArrow(store, "range int, words array<long>").collect()}  # one row for each file
    classes = tuple(found.get(r, (0,) * _CLASSES) for r in range(ranges))
    return Vocabulary(folder, bits, tuple(map(sum, classes)), tokens, classes)


# N-grams


_ZSTD = pa.Codec("zstd", compression_level=3)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, the first of them in order and kept as differences, each as wide as its largest, compressed."""
    n, parts = len(columns[0]), []
    for k, c in enumerate(columns):
        c = np.diff(c.astype(np.uint64), prepend=np.uint64(0)) if k == 0 else c.astype(np.uint64)
        width = (int(c.max()).bit_length() + 7) // 8 if n else 0
        parts.append((width, np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()))
    raw = b"".join(x for _, x in parts)
    head = np.array([n, len(raw), *(w for w, _ in parts)], np.int64).tobytes()
    return len(columns).to_bytes(8, "little") + head + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def _unpacked(blob: bytes) -> list[np.ndarray]:
    """The columns as 64-bit numbers without sign."""
    k = int.from_bytes(blob[:8], "little")
    n, size, *widths = np.frombuffer(blob, np.int64, k + 2, 8).tolist()
    raw = np.frombuffer(pa.decompress(blob[8 * (k + 3) :], decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for j, w in enumerate(widths):
        c = np.zeros((n, 8), np.uint8)
        c[:, :w] = raw[at : at + n * w].reshape(w, n).T
        at += n * w
        c = c.view(np.uint64).ravel()
        out.append(np.cumsum(c, dtype=np.uint64) if j == 0 else c)
    return out


def _joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(_unpacked, blobs), strict=True)]


def key_of(ids: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each run of word numbers; one column for each place."""
    key = np.full(len(ids[0]), len(ids), np.uint64)
    for c in ids:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    return key


def _grams(ids: np.ndarray, sizes: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """For each token the order - 1 words before it, `start` before a text's first, and itself, as columns."""
    before = order - 1
    padded = np.full(len(ids) + before * len(sizes), start, np.int64)
    place = np.arange(len(ids)) + before * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[place] = ids
    return [padded[place - before + j] for j in range(order)]


@dataclass(frozen=True)
class Layout:
    """How the n-grams of one order are dealt: over parts, each a file, and within a part over ranges of hashes, one of
    which is in memory at a time."""

    parts: int
    bits: int
    a_bucket: int

    @classmethod
    def of(cls, tokens: int, a_bucket: int, most_parts: int) -> Layout:
        buckets = max(1, -(-tokens // a_bucket))
        parts = min(buckets, most_parts)
        # a row is several columns, and there are copies while rows are sorted and summed: a quarter is held at a time
        return cls(parts, max(0, int(np.ceil(np.log2(buckets / parts)))) + 2, a_bucket)

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) % np.uint64(self.parts)).astype(np.int64)

    def salted_part_of(self, contexts: np.ndarray, last: np.ndarray, most: np.ndarray) -> np.ndarray:
        """By the words before the last; a context that may occur more than a_bucket times is dealt by its last word too."""
        salts = (1 + 4 * most // self.a_bucket).astype(np.uint64)
        return self.part_of(contexts + mixed(last.astype(np.uint64)) % salts)

    def range_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.parts, "part").sortWithinPartitions("part", "range")


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last + 1 of each run of equal values."""
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _blobs(parts: np.ndarray, ranges: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """The columns by part and range, in the order of the first column."""
    to = parts * (int(ranges.max(initial=0)) + 1) + ranges
    key, size = to.astype(np.uint64), int(to.max(initial=0)) + 1
    for c in columns[:2]:  # sorted by the second column too, as far as 64 bits hold that, they pack better
        top = int(c.max(initial=0)) + 1
        if size * top < 2**64:
            key, size = key * np.uint64(top) + c.astype(np.uint64), size * top
    order = _order(key) if size > int(to.max(initial=0)) + 1 else np.lexsort((columns[0], to))
    for a, b in _runs(to[order]):
        rows = order[a:b]
        yield int(parts[rows[0]]), int(ranges[rows[0]]), _packed([c[rows] for c in columns])


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


_BLOB_TYPES = {"part": pa.int32(), "range": pa.int32(), "blob": pa.binary()}


def _counted(words: Vocabulary, order: int, layout: Layout, texts: int, room: int = 1_200_000):
    """Distinct n-grams of some texts with their counts, dealt to the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # key, part, count and words

        def merge() -> None:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            by = _order(columns[0])
            first = _firsts(columns[0][by])
            held[:] = [[np.add.reduceat(c[by], first) if k == 2 and len(first) else c[by[first]] for k, c in enumerate(columns)]]

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                merge()
                keys, parts, counts, *ids = held.pop()
                for blob in _blobs(parts, layout.range_of(keys), [*ids, counts]):
                    yield _batch([blob], _BLOB_TYPES)

        new = 0
        for b in slices(batches):
            hashes, codes, sizes = hashed_tokens(utf8(b.column(0)))
            ids, n = words.find(hashes)
            places, _, counts = _distinct(_grams(codes, sizes, order, len(hashes)))
            grams = [np.append(ids, words.words)[c] for c in places]
            parts = layout.salted_part_of(key_of(grams[:-1]), grams[-1], _least(places[:-1], n, texts)).astype(np.int32)
            keys = key_of(grams)
            held.append([keys, parts, counts, *grams])
            new += len(keys)
            if new > room // 2:
                merge()
                new = 0
                if len(held[0][0]) > room:
                    yield from flush()
        yield from flush()

    return run


def _distinct(grams: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows of grams, which of them each row is, and how often each occurs."""
    of, keys = pd.factorize(key_of(grams))
    first = np.zeros(len(keys), np.int64)
    first[of] = np.arange(len(of))  # any row of a key does
    return [g[first] for g in grams], of, np.bincount(of, minlength=len(keys))


def _least(places: list[np.ndarray], counts: np.ndarray, starts: int) -> np.ndarray:
    """The least count of each row's words: how often the row may occur at most. places: of its words among those of the
    batch, which have these counts; the start of a text comes after them."""
    of = np.append(counts, starts)
    return np.minimum.reduce([of[p] for p in places])


#: What is kept about each n-gram below the highest order: its occurrences as a context, its continuations seen once, twice
#: and more often, and the number of words before it (for n-grams at a text's start, their occurrences).
CONTEXT = ("total", "once", "twice", "more", "before")


def _summed_by(keys: np.ndarray, columns: list[np.ndarray], ids: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, sums of the columns and the words of each."""
    by = _order(keys)
    first = _firsts(keys[by])
    return keys[by[first]], [np.add.reduceat(c[by], first) if len(first) else c for c in columns], [c[by[first]] for c in ids]


def _shorter(ids: list[np.ndarray], counts: np.ndarray, start: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What n-grams say of those one word shorter: words and CONTEXT, one row for each context and each ending."""
    one = np.ones(len(counts), np.int64)
    as_context = [counts, *((ok * one) for ok in (counts == 1, counts == 2, counts >= 3)), 0 * one]
    starts = ids[1] == start if len(ids) > 2 else np.zeros(len(one), bool)
    as_ending = [0 * one] * 4 + [np.where(starts, counts, one)]
    both = []
    for words, columns in ((ids[:-1], as_context), (ids[1:], as_ending)):
        _, sums, distinct = _summed_by(key_of(words) if len(words) > 1 else words[0].astype(np.uint64), columns, words)
        both.append((distinct, sums))
    return tuple([np.concatenate([x, y]) for x, y in zip(both[0][k], both[1][k], strict=True)] for k in (0, 1))


_TOLD = {**_BLOB_TYPES, "sums": pa.list_(pa.int64())}
_TOLD_SQL = "part int, range int, blob binary, sums array<long>"
_FULL = 2**8 - 1  # stands for this and higher numbers, which are in a file of their own


#: Rows of CONTEXT that one byte stands for: those of rare contexts, whose total is told by the rest. 255 stands for others.
_RARE = np.array([[o + 2 * w, o, w, 0, b] for o in range(6) for w in range(3) for b in range(14)] + [[_FULL] * len(CONTEXT)] * 4)


def _narrowed(about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each row of numbers, and which rows it doesn't hold."""
    if about.shape[1] == 1:
        return np.minimum(about[:, 0], _FULL).astype(np.uint8), about[:, 0] >= _FULL
    total, once, twice, more, before = about.T
    rare = (more == 0) & (once < 6) & (twice < 3) & (before < 14) & (total == once + 2 * twice)
    return np.where(rare, (once * 3 + twice) * 14 + before, _FULL).astype(np.uint8), ~rare


def _widened(low: np.ndarray, width: int) -> np.ndarray:
    """The rows of numbers; all of a row that a byte doesn't hold are _FULL."""
    return low[:, None].astype(np.int64) if width == 1 else _RARE[low]


_KEY = 40  # bits of a key that are stored; those before them are told by its place


def _place_bits(n: int) -> int:
    """How many leading bits of a key tell its place among n keys, about 64 of which share them."""
    return max(0, n.bit_length() - 7)


class Keys:
    """A file of sorted keys, five bytes each, and one of where the keys of each run of leading bits begin. Not all bits of a
    key are kept: one that is not there is taken for one that is once in 10**10."""

    @staticmethod
    def save(folder: str, name: str, keys: list[np.ndarray]) -> None:
        n = sum(map(len, keys))
        bits, file, counts = _place_bits(n), Appender(folder, name), np.zeros(1, np.int64)
        for k in keys:
            file.add(Keys._stored(k, bits).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEY // 8])
            counts = counts + np.bincount(Keys._run(k, bits), minlength=2**bits)
        file.add(np.zeros(3, np.uint8))  # eight bytes are read at once
        file.close()
        save(folder, f"starts-of-{name}", np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32 if n < 2**32 else np.int64))

    @staticmethod
    def _run(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)

    @staticmethod
    def _stored(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys << np.uint64(bits)) >> np.uint64(64 - _KEY)

    @staticmethod
    def find(folder: str, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place, and whether it is there."""
        raw = load(folder, name, "uint8")
        n = len(raw) // (_KEY // 8)
        stored = np.ndarray(n, "<u8", raw, strides=(_KEY // 8,))
        mask, bits = np.uint64(2**_KEY - 1), _place_bits(n)
        wanted, run = Keys._stored(keys, bits), Keys._run(keys, bits)
        starts = load(folder, f"starts-of-{name}", "uint32" if n < 2**32 else "int64")
        low, high = starts[run].astype(np.int64), starts[run + 1].astype(np.int64)
        ends = high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = open_ & ((stored[np.minimum(middle, n - 1)] & mask) < wanted)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        at = np.minimum(low, n - 1)
        return at, (low < ends) & ((stored[at] & mask) == wanted)


def _closed(batches: Iterator[pa.RecordBatch], told: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with n-grams; those with counts of counts, which earlier orders pass on, go to `told`."""
    for b in batches:
        counts = b.column("range").to_numpy() < 0
        if counts.any():
            told.append(b.filter(pa.array(counts)).select(list(_TOLD)))
            b = b.filter(pa.array(~counts))
        yield b


def _tables(folder: str, order: int, below: Layout | None, block: int, start: int):
    """Writes the n-grams of one order, part by part; gives on what they say of the next order down, and for each part a row
    of range -1 with the order and counts of counts; such rows of higher orders pass through. below: the layout of that order, None for blocks of words."""

    def close(part: int, files: list[Appender], kept: list[np.ndarray], sums: np.ndarray) -> pa.RecordBatch:
        for f in files:
            f.close()
        Keys.save(folder, f"keys-{order}-{part}", kept)
        return _batch([(part, -1, None, [order, *sums.tolist()])], _TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part, files, kept, sums, passed = None, [], [], np.zeros(4, np.int64), []
        for (part, _), held in _grouped(_closed(batches, passed), 2):
            if part != open_part:
                if files:
                    yield close(open_part, files, kept, sums)
                open_part, files, sums, kept = part, [Appender(folder, f"{name}-{order}-{part}") for name in ("about", "large")], np.zeros(4, np.int64), []
            columns = _joined([x for b in held for x in b.column("blob").to_pylist()])
            keys, numbers, ids = _summed_by(key_of(columns[:order]), [c.astype(np.int64) for c in columns[order:]], columns[:order])
            about = np.stack(numbers, 1)
            low, large = _narrowed(about)
            kept.append(keys)
            files[0].add(low)
            files[1].add(np.concatenate([keys[large, None].view(np.int64), about[large]], 1))
            counts = numbers[-1]
            sums += [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            seen = counts > 0
            shorter, told = _shorter([c[seen] for c in ids], counts[seen], start)
            if below:
                to, ranges = below.part_of(key_of(shorter)), below.range_of(key_of(shorter))
            else:
                to, ranges = (shorter[0] % np.uint64(start // block + 1)).astype(np.int64), np.zeros(len(shorter[0]), np.int64)
            yield _batch([(*blob, None) for blob in _blobs(to, ranges, [*shorter, *told])], _TOLD)
        if files:
            yield close(open_part, files, kept, sums)
        yield from passed

    return run


def _blocks(folder: str, block: int, blocks: int):
    """Writes what is known about the words of each block; gives order 1, counts of counts, and all and the high ones' number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for (name, _), held in _grouped(_closed(batches, passed), 2):
            table = np.zeros((len(CONTEXT), block), np.int64)
            size = 0
            for blob in (x for b in held for x in b.column("blob").to_pylist()):
                ids, *numbers = _unpacked(blob)
                at = (ids // np.uint64(blocks)).astype(np.int64)
                size = max(size, int(at.max(initial=-1)) + 1)
                for k, c in enumerate(numbers):
                    np.add.at(table[k], at, c.astype(np.int64))
            about = table[:, :size].T
            low, large = _narrowed(about)
            save(folder, f"words-of-block-{name}", low)
            save(folder, f"large-of-block-{name}", np.concatenate([np.flatnonzero(large)[:, None], about[large]], 1))
            before = table[CONTEXT.index("before")]
            yield _batch([(name, -1, None, [1, *(int((before == k).sum()) for k in (1, 2, 3, 4)), int(before.sum()), int((before >= 3).sum())])], _TOLD)
        yield from passed

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; half of each count's place where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def _cut(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(0.0, counts - np.select([counts <= 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2]))


@dataclass(frozen=True)
class Model:
    """discounts: of each order from 1 up; parts: those of each order from 2 up that hold any n-gram."""

    words: Vocabulary
    order: int
    layout: Layout
    block: int
    starts: int
    discounts: tuple[tuple[float, float, float], ...]
    parts: tuple[frozenset[int], ...]
    unigrams: int
    low_rest: float

    def _about_words(self, ids: np.ndarray) -> np.ndarray:
        """CONTEXT for each word number; zeros for unknown ones."""
        out = np.zeros((len(ids), len(CONTEXT)), np.int64)
        known = np.flatnonzero(ids >= 0) if self.unigrams else np.zeros(0, np.int64)  # without training there are no files
        blocks = self.words.words // self.block + 1
        order = known[_order(ids[known] % blocks)]
        to = ids[order] % blocks
        for a, b in _runs(to):
            table = load(self.words.folder, f"words-of-block-{to[a]}", "uint8")
            at = ids[order[a:b]] // blocks
            found = _widened(table[at], len(CONTEXT))
            if (full := (found == _FULL).any(1)).any():
                large = load(self.words.folder, f"large-of-block-{to[a]}", "int64").reshape(-1, len(CONTEXT) + 1)
                found[full] = large[np.searchsorted(large[:, 0], at[full]), 1:]
            out[order[a:b]] = found
        return out

    def _about(self, order: int, keys: np.ndarray, to: np.ndarray) -> np.ndarray:
        """CONTEXT for each n-gram below the highest order, the count alone for the highest; zeros for those not seen."""
        width = 1 if order == self.order else len(CONTEXT)
        out = np.zeros((len(keys), width), np.int64)
        by = _order(keys)
        by = by[_order(to[by])]
        for a, b in _runs(to[by]):
            rows, part = by[a:b], int(to[by[a]])
            if part not in self.parts[order - 2]:
                continue
            at, ok = Keys.find(self.words.folder, f"keys-{order}-{part}", keys[rows])
            found = _widened(load(self.words.folder, f"about-{order}-{part}", "uint8")[at[ok]], width)
            if (found == _FULL).any():
                large = load(self.words.folder, f"large-{order}-{part}", "int64").reshape(-1, width + 1)
                full = (found == _FULL).any(1)
                found[full] = large[np.searchsorted(large[:, 0].view(np.uint64), keys[rows][ok][full]), 1:]
            out[rows[ok]] = found
        return out

    def probabilities(self, places: list[np.ndarray], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """p(last word | words before) for rows of places in ids, word numbers with their counts in training; -1 is an unknown
        word, the place after them the start of a text."""
        numbers = np.append(ids, self.words.words)  # the start of a text is numbered after the words
        grams, least = [numbers[p] for p in places], _least(places[:-1], counts, self.starts)
        after, d, about = grams[-1], self.discounts, self._about_words(numbers)
        p = _cut(about[places[-1], 4], d[0]) / max(1, self.unigrams) + self.low_rest / (self.words.words + 1)
        context = about[places[-2]]
        for k in range(2, self.order + 1):
            ids = grams[-k:]
            keys, total = key_of(ids), np.maximum(1, context[:, 0])
            rest = (d[k - 1][0] * context[:, 1] + d[k - 1][1] * context[:, 2] + d[k - 1][2] * context[:, 3]) / total
            if k == self.order:
                counts = self._about(k, keys, self.layout.salted_part_of(key_of(ids[:-1]), after, least))[:, 0]
            else:
                longer = key_of(grams[-k - 1 : -1])  # the context of the next order
                place, both = pd.factorize(np.concatenate([keys, longer]))
                about = self._about(k, both, self.layout.part_of(both))[place]
                counts = about[: len(keys), 4]
            p = np.where(context[:, 0] > 0, _cut(counts, d[k - 1]) / total + rest * p, p)
            context = about[len(keys) :] if k < self.order else context
        return p

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        hashes, codes, sizes = hashed_tokens(texts)
        ids, counts = self.words.find(hashes)
        places, of, _ = _distinct(_grams(codes, sizes, self.order, len(hashes)))
        p = np.log10(self.probabilities(places, ids, counts))[of]
        base = np.log10((counts + 0.1) / (self.words.tokens + 0.1 * (self.words.words + 1)))[codes]
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        return {"n_tokens": sizes, "n_known": add((counts > 0)[codes].astype(np.int64)), "base_score": add(base), "score": add(p)}


def learn(docs: DataFrame, order: int = 3, a_bucket: int = 2_000_000, block: int = 500_000, most_parts: int = 4_096) -> Model:
    """A model of all texts of docs (text).

    a_bucket: tokens whose n-grams a task holds at once, about; block: words of a block; most_parts: files of an order.
    """
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark, texts = docs.sparkSession, docs.select("text")
    folder = f"{shared_dir(spark)}/pairloom-lm-{uuid.uuid4().hex}"
    words = vocabulary(texts, folder)
    starts = texts.count()
    layout = Layout.of(words.tokens, a_bucket, most_parts)
    rows = layout.dealt(texts.mapInArrow(_counted(words, order, layout, starts), "part int, range int, blob binary"))
    for k in range(order, 1, -1):  # one job; what an order says of the next is shuffled only, not written besides
        rows = rows.mapInArrow(_tables(folder, k, layout if k > 2 else None, block, words.words), _TOLD_SQL)
        rows = layout.dealt(rows) if k > 2 else rows.repartition(words.words // block + 1, "part").sortWithinPartitions("part", "range")
    told = rows.mapInArrow(_blocks(folder, block, words.words // block + 1), _TOLD_SQL)
    each = told.groupBy(F.col("sums")[0].alias("order")).agg(*(F.coalesce(F.sum(F.try_element_at("sums", F.lit(j))), F.lit(0)) for j in range(2, 8)), F.collect_set("part"))
    sums = {r[0]: r[1:] for r in each.collect()}  # one row for each order; its parts are at most most_parts
    found = [discounts(*sums[k][:4]) if k in sums else discounts(0, 0, 0, 0) for k in range(2, order + 1)]
    parts = [frozenset(sums[k][6]) if k in sums else frozenset() for k in range(2, order + 1)]
    *n, total, many = sums[1][:6] if 1 in sums else [0] * 6
    low = discounts(*n)
    rest = (low[0] * n[0] + low[1] * n[1] + low[2] * many) / total if total else 1.0
    return Model(words, order, layout, block, starts, (low, *found), tuple(parts), total, rest)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity for each row of docs (doc_id, text)."""
    names = ("n_tokens", "n_known", "base_score", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = model.score(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[n]) for n in names)], ["doc_id", *names])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

