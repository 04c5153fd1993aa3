"""Benchmark decontamination by winnowing.

Both sides keep the least hash of the k-word grams in each window of w grams: about 2 / (w + 1) of all grams. A window of
`window` words has just w grams, so every shared span of that many words keeps the same fingerprint on both sides. The
fingerprints of documents are joined with those of the items, and each hit is extended to the windows that kept it: they
are looked up, word by word, among the items' distinct windows, each of which knows its items as one numbered list. So work
grows with the words of a text and not with how often a word repeats or how many items share a phrase.
Items shorter than a window are one window of their own and are looked up whole.
Null and empty texts have no words: such a document is clean, such an item has no windows. Items with equal texts all
count; the windows of items without an id count as hits, but such items are not listed. Repeated document rows are judged
one by one. Other columns are ignored.
An index of the items is broadcast if they have at most max_chars characters in all; more are joined by fingerprint, then
by window. Either way no pairs of documents and items arise but those of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import mixed, plain_words, slices, utf8
from pairloom.sources.tables import written

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so hashes of grams at different offsets differ
_NONE = np.uint64(2**64 - 1)


def gram_hashes(ids: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n word numbers; _NONE for runs with an unknown word (-1)."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    word, known = mixed((ids + 1).astype(np.uint64) + np.uint64(77 + salt)), ids >= 0
    h, ok = np.zeros(m, np.uint64), np.ones(m, bool)
    for j in range(n):
        h = h * _P + word[j : j + m]
        ok &= known[j : j + m]
    return np.where(ok, np.minimum(mixed(h), _NONE - np.uint64(1)), _NONE)


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """The least gram of each window of w grams; _NONE where one is unknown."""
    m = len(grams) - w + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    least, top = grams[:m].copy(), grams[:m].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : j + m], out=least)
        np.maximum(top, grams[j : j + m], out=top)
    return np.where(top == _NONE, _NONE, least)


@dataclass(frozen=True)
class Winnowing:
    window: int = 10
    k: int = 5

    @property
    def w(self) -> int:
        """Grams a window, so that every shared span of `window` words has a fingerprint in common."""
        return self.window - self.k + 1

    def kept(self, ids: np.ndarray) -> np.ndarray:
        """The fingerprint that each window of word numbers keeps."""
        return winnowed(gram_hashes(ids, self.k), self.w)


@dataclass(frozen=True)
class Windows:
    """Distinct windows of one length, by hash: a place where each stands in the items' words, and its list of items."""

    hashes: np.ndarray
    places: np.ndarray
    lists: np.ndarray


class ItemIndex:
    """Fingerprints and distinct windows of some items; as large as a few times their texts."""

    def __init__(self, items: Iterable[tuple[object, bytes]], how: Winnowing):
        self.how, self.vocabulary, self.item_ids, texts = how, {}, [], {}
        number = self.vocabulary.setdefault
        for item_id, text in items:
            if words := tuple(plain_words(text)):
                if words not in texts:
                    texts[words] = len(self.item_ids)
                    self.item_ids.append([])  # of all items with these words
                if item_id is not None:
                    self.item_ids[texts[words]].append(item_id)
        runs = [np.array([number(x, len(self.vocabulary)) for x in words], np.int32) for words in texts]
        sizes = np.array([len(r) for r in runs], np.int64)
        self.starts = np.cumsum([0, *(sizes + 1)])
        self.words = np.concatenate([np.zeros(0, np.int32), *(np.append(r, -2) for r in runs)]).astype(np.int32)  # -2 equals no word
        self.lists, self.salts, self.windows = [np.array([i]) for i in range(len(runs))], {}, {}
        numbers: dict[bytes, int] = {}
        for n in sorted({min(x, how.window) for x in sizes.tolist()}):
            if n < how.window:
                places = self.starts[:-1][sizes == n]
            else:
                places = np.flatnonzero(gram_hashes(self.words, n) != _NONE)
            self.windows[n] = self._distinct(places, n, numbers)
        self.prints = np.unique(how.kept(self.words))
        self.prints = self.prints[self.prints != _NONE]

    def _distinct(self, places: np.ndarray, n: int, numbers: dict[bytes, int]) -> Windows:
        for salt in count():  # until no two unlike windows have one hash
            hashes = gram_hashes(self.words, n, salt)[places]
            order = np.lexsort((places, hashes))
            h, at = hashes[order], places[order]
            first = np.append(True, h[1:] != h[:-1])
            group, stands = np.cumsum(first) - 1, at[first]
            if all((self.words[at + j] == self.words[stands[group] + j]).all() for j in range(n)):
                break
        self.salts[n] = salt
        pairs = np.unique(group * len(self.item_ids) + np.searchsorted(self.starts, at, "right") - 1)
        group, owner = np.divmod(pairs, len(self.item_ids))
        ends = np.searchsorted(group, np.arange(len(stands) + 1))
        lists = owner[ends[:-1]].copy()  # the list of text i alone has the number i
        for g in np.flatnonzero(np.diff(ends) > 1).tolist():
            own = owner[ends[g] : ends[g + 1]]
            lists[g] = numbers.setdefault(own.tobytes(), len(self.lists))
            if lists[g] == len(self.lists):
                self.lists.append(own)
        return Windows(h[first], stands, lists)

    def numbers(self, words: list[bytes]) -> list[int]:
        get = self.vocabulary.get
        return [get(w, -1) for w in words]

    def of_list(self, number: int) -> Iterator[object]:
        """The ids of the items of a list."""
        return (x for i in self.lists[number].tolist() for x in self.item_ids[i])

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last + 1 place and list of each window of word numbers that items have; -1 is no item's word."""
        out = [(np.zeros(0, np.int64),) * 3]
        for n, of in self.windows.items():
            hashes = gram_hashes(ids, n, self.salts[n])
            at = np.flatnonzero(_member(self.how.kept(ids), self.prints) if n == self.how.window else hashes != _NONE)
            k = np.minimum(np.searchsorted(of.hashes, hashes[at]), len(of.hashes) - 1)
            same = of.hashes[k] == hashes[at]
            at, k = at[same], k[same]
            same = np.ones(len(at), bool)
            for j in range(n):
                same &= ids[at + j] == self.words[of.places[k] + j]
            out.append((at[same], at[same] + n, of.lists[k[same]]))
        a, b, lists = zip(*out, strict=True)
        return np.concatenate(a), np.concatenate(b), np.concatenate(lists)


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of half-open runs, flat and in order."""
    if not len(a):
        return np.zeros(0, np.int64)
    size = int(b.max()) + 1
    covered = np.cumsum(np.bincount(a, minlength=size) - np.bincount(b, minlength=size)) > 0
    return np.flatnonzero(np.diff(covered, prepend=False))


def _search(docs: DataFrame, items: list[tuple[object, bytes]], how: Winnowing, id_type: str) -> DataFrame:
    """docs with words_, hit_ and items_ by a broadcast index."""
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, how))
    schema = docs.withColumns(_none(id_type)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for b in slices(batches):
            words = [plain_words(t) for t in utf8(b.column("text"))]
            ids = np.array([x for ws in words for x in (*found.numbers(ws), -1)], np.int32)
            ends = np.cumsum([len(ws) + 1 for ws in words])
            hit, held = [[] for _ in words], [set() for _ in words]
            p, q, lists = found.hits(ids)
            for x, y in merged(p, q).reshape(-1, 2).tolist():
                d = int(np.searchsorted(ends, x, "right"))
                first = int(ends[d]) - len(words[d]) - 1
                hit[d] += [x - first, y - first]
            for x in np.unique(np.searchsorted(ends, p, "right") * len(found.lists) + lists).tolist() if len(p) else ():
                held[x // len(found.lists)].update(found.of_list(x % len(found.lists)))
            out = {"words_": [len(ws) for ws in words], "hit_": hit, "items_": [sorted(x, key=str) for x in held]}
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(out[n], pa_type) for n, pa_type in (("words_", pa.int64()), ("hit_", pa.list_(pa.int32())), ("items_", pa.list_(_ARROW.get(id_type, pa.string())))))], [*b.schema.names, *out])

    return docs.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}


def _none(id_type: str) -> dict:
    return {"words_": F.lit(0).cast("long"), "hit_": F.array().cast("array<int>"), "items_": F.array().cast(f"array<{id_type}>")}


def _hashed(words: list[bytes]) -> np.ndarray:
    return (pd.util.hash_array(np.array(words, object), categorize=False) >> np.uint64(1)).astype(np.int64) if words else np.zeros(0, np.int64)


def _prints(ids: np.ndarray, how: Winnowing, short: Iterable[int]) -> dict[int, np.ndarray]:
    """The fingerprint that each window keeps, and the hash of each run of the short lengths, by length."""
    return {how.window: how.kept(ids), **{n: gram_hashes(ids, n) ^ np.uint64(n) for n in short}}


def _distinct_prints(how: Winnowing, short: tuple[int, ...]):
    """key and distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for key, text in zip(b.column("key").to_pylist(), utf8(b.column("text")), strict=True):
                found = np.unique(np.concatenate(list(_prints(_hashed(plain_words(text)), how, short).values())))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(found.view(np.int64))], ["key", "print"])

    return run


_WINDOW = "key string, print long, n int, win string, places array<int>"


def _windows(how: Winnowing, short: tuple[int, ...]):
    """The distinct windows of texts with their places. Where there is a column of met fingerprints, only windows that keep
    one of them, and runs of the short lengths; else all, and a short text whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            met = b.column("met").to_pylist() if "met" in b.schema.names else [None] * b.num_rows
            for key, text, of in zip(b.column("key").to_pylist(), utf8(b.column("text")), met, strict=True):
                words = plain_words(text)
                lengths = short if of is not None else (len(words),) if 0 < len(words) < how.window else ()
                found: dict[bytes, tuple[int, int, list[int]]] = {}
                for n, prints in _prints(_hashed(words), how, lengths).items():
                    for p in range(len(prints)) if of is None else np.flatnonzero(np.isin(prints, np.array(of, np.int64).view(np.uint64))).tolist():
                        found.setdefault(b" ".join(words[p : p + n]), (int(prints[p : p + 1].view(np.int64)[0]), n, []))[2].append(p)
                columns = zip(*found.values(), strict=True) if found else [()] * 3
                types = (pa.int64(), pa.int32(), pa.list_(pa.int32()))
                prints_, sizes, places = (pa.array(c, t) for c, t in zip(columns, types, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), prints_, sizes, pa.array(list(found), pa.binary()).cast(pa.string()), places], ["key", "print", "n", "win", "places"])

    return run


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the union of its windows (sizes n, their places)."""
    for b in batches:
        runs = []
        for sizes, places in zip(b.column("sizes").to_pylist(), b.column("places").to_pylist(), strict=True):
            a = np.array([p for ps in places for p in ps], np.int64)
            runs.append(merged(a, a + np.repeat(sizes, [len(ps) for ps in places])))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(runs, pa.list_(pa.int32()))], ["key_", "hit_"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(plain_words(t)) for t in utf8(b.column("text"))], pa.int64())], [*b.schema.names, "words_"])


def _join(docs: DataFrame, items: DataFrame, how: Winnowing, id_type: str) -> DataFrame:
    """docs with words_, hit_ and items_ by joins of fingerprints, then of windows; equal texts are looked up once."""
    keyed = lambda df: df.where("text is not null").groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"))
    texts = written(keyed(docs), "texts")
    owned = written(keyed(items).mapInArrow(_windows(how, ()), _WINDOW).select("key", "print", "n", "win"), "item-windows")
    short = tuple(sorted(r.n for r in owned.where(F.col("n") < how.window).select("n").distinct().collect()))  # fewer than `window` numbers
    # windows of the same items have one list; two sums of hashes of the items' keys tell lists apart
    sums = [F.sum(F.xxhash64("key", F.lit(i)).cast("decimal(20,0)")) for i in range(2)]
    listed = written(owned.groupBy("win", "print").agg(F.sha2(F.concat_ws(",", F.count("*"), *sums), 256).alias("list")), "windows")
    ids = items.where("text is not null and item_id is not null").select(F.sha2("text", 256).alias("key"), "item_id").distinct()
    of_list = listed.groupBy("list").agg(F.min("win").alias("win")).join(owned.select("key", "win"), "win").join(ids, "key").select("list", "item_id")
    prints = texts.mapInArrow(_distinct_prints(how, short), "key string, print long")
    met = prints.join(listed.select("print").distinct(), "print", "left_semi").groupBy("key").agg(F.collect_set("print").alias("met"))
    windows = met.join(texts, "key").select("key", "text", "met").mapInArrow(_windows(how, short), _WINDOW)
    hits = written(windows.join(listed.select("win", "list"), "win").select("key", "n", "places", "list"), "hits")
    of_items = hits.select("key", "list").distinct().join(of_list, "list").groupBy(F.col("key").alias("key_")).agg(F.collect_set("item_id").alias("items_"))
    covered = hits.groupBy("key").agg(F.collect_list("n").alias("sizes"), F.collect_list("places").alias("places")).mapInArrow(_covered, "key_ string, hit_ array<int>")
    found = written(covered.join(of_items, "key_", "left"), "covered")
    told = docs.mapInArrow(_counted, docs.withColumn("words_", F.lit(0).cast("long")).schema).withColumn("key_", F.sha2("text", 256)).join(found, "key_", "left")
    none = _none(id_type)
    return told.withColumns({c: F.coalesce(c, none[c]) for c in ("hit_", "items_")}).select(*docs.columns, "words_", "hit_", "items_")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits = [sum(x[1::2]) - sum(x[::2]) for x in b.column("hit_").to_pylist()]
        items = b.column("items_").to_pylist()
        sums = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sums)], [*b.schema.names, "n_hit", "n_items", "items_sha256"])


def find_hits(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing(), max_chars: int = 8_000_000) -> DataFrame:  # noqa: B008
    """docs (text and any other columns) with words_, hit_ and items_."""
    id_type = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", "text").where("text is not null")
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= max_chars:
        return _search(docs, [(r.item_id, r.text.encode()) for r in items.collect()], how, id_type)
    return _join(docs, items, how, id_type)


def decontaminate(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing(), max_chars: int = 8_000_000) -> DataFrame:  # noqa: B008
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids for each row of docs (doc_id, text)."""
    found = find_hits(docs.select("doc_id", "text"), items, how, max_chars).select("doc_id", F.col("words_").alias("n_words"), "hit_", "items_")
    types = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in found.schema)}, n_hit long, n_items long, items_sha256 string"
    return found.mapInArrow(_digest, types).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), F.col("items_").alias("item_ids"))


def keep_clean(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:  # noqa: B008
    """The rows of docs without any window of an item, in their own columns."""
    packed = docs.select(F.struct("*").alias("row_"), "text")
    return find_hits(packed, items, how).where(F.size("hit_") == 0).select("row_.*")


ORACLE = r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) p from (select item_id, w, least(len(w), 10) n from i where len(w) > 0))),
dw as (select rid, p, n, array_to_string(w[p:p + n - 1], ' ') g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from iw) where len(w) >= n)),
hits as (select rid, p, n, item_id from dw join iw using (n, g)),
covered as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + n)) q from hits) group by rid),
found as (select rid, count(*) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from (select distinct rid, item_id from hits where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (rid) left join found using (rid)"""
