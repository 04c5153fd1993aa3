"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A signature is `size` minima of hashed 4-word shingles, of which b bits each are kept. Texts of Jaccard similarity 0.8
differ in a fifth of the values on average; `distance` lies 4.7 standard deviations above, so about 1 in 100,000 pairs
just at the threshold is beyond it and hardly any above. Signatures are cut into `chunks`; by the pigeonhole principle
two within the distance have a chunk with at most distance // chunks errors, and all ways to leave out so many values
of each chunk are the keys under which a signature is filed. So every pair within the distance meets under some key.

Equal sets are one class from the start. Under each key, classes are first compared with one centre, in proportion to
the rows. Links are confirmed on full shingle sets and joined to components. Then classes of different components that
share a key are compared by signature inside the tasks, large keys in blocks; those with a candidate within the
distance come together again with their texts, and full sets are compared inside the tasks. Only links that join two
components are written, so no list of pairs arises. A link inside one component needs no further look, so components
are those of all links.

Empty and null texts have no shingles and are linked with nothing. Texts of fewer than 4 words have one shingle.
Rows without a doc_id take no part in links: they have no component and are kept. Repeated rows are linked with each
other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.words import mixed, slices, spaced_words, utf8
from pairloom.sources.tables import written

_P = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Signatures:
    size: int = 96
    bits: int = 16
    distance: int = 37
    chunks: int = 19

    def parts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.size), self.chunks)

    def keys(self) -> list[np.ndarray]:
        """The places that each key takes: a chunk without each choice of as many values as it may err in."""
        errors = self.distance // self.chunks
        return [np.delete(part, list(drop)) for part in self.parts() for drop in combinations(range(len(part)), min(errors, len(part) - 1))]


def shingle_sets(texts: list[bytes], n: int = 4) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as sorted 64-bit hashes."""
    words = [spaced_words(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [x for w in words for x in w]
    if not len(flat):
        return [np.zeros(0, np.uint64) for _ in texts]
    codes, unique = pd.factorize(flat)
    word = pd.util.hash_array(unique, categorize=False)[codes]
    h = np.zeros(len(flat), np.uint64)
    for j in range(n):
        h[: len(flat) - j] = h[: len(flat) - j] * _P + word[j:] if j else word
    grams, ends, out = mixed(h), np.cumsum(sizes), []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        if size >= n:
            out.append(np.unique(grams[end - size : end - n + 1]))
        elif size:
            whole = np.uint64(size)
            for x in word[end - size : end]:
                whole = np.uint64((int(whole) * int(_P) + int(x)) % 2**64)
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], how: Signatures) -> np.ndarray:
    """One signature a row; sets must not be empty."""
    out = np.zeros((len(sets), how.size), np.uint16 if how.bits <= 16 else np.uint32)
    if not sets:
        return out
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    factors = mixed(np.arange(1, how.size + 1, dtype=np.uint64)) | np.uint64(1)
    for i, a in enumerate(factors):
        out[:, i] = np.minimum.reduceat((flat ^ (a >> np.uint64(7))) * a, starts) >> np.uint64(64 - how.bits)
    return out


def _long_keys(signatures: np.ndarray, how: Signatures) -> np.ndarray:
    keys = []
    for i, places in enumerate(how.keys()):
        h = np.full(len(signatures), mixed(np.array([i + 1]))[0])
        for j in places:
            h = mixed(h * _P + signatures[:, j].astype(np.uint64))
        keys.append(h)
    return np.stack(keys, 1).astype(np.int64) if keys else np.zeros((len(signatures), 0), np.int64)


def _signed(how: Signatures):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(utf8(b.column(1)))
            full = [s for s in sets if len(s)]
            signed = iter(minima(full, how))
            rows = [next(signed).tobytes() if len(s) else None for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return run


def _filed(how: Signatures):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16 if how.bits <= 16 else np.uint32).reshape(-1, how.size)
            keys = _long_keys(s, how)
            offsets = pa.array(np.arange(len(s) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["rep", "keys"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            left, right = utf8(b.column(2)), utf8(b.column(3))
            distinct = {t: k for k, t in enumerate(dict.fromkeys(left + right))}
            sets = shingle_sets(list(distinct))
            ok = []
            for x, y in zip(left, right, strict=True):
                x, y = sets[distinct[x]], sets[distinct[y]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], ["a", "b", "linked"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b and linked for distinct pairs (a, b), from the whole texts."""
    sides = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(_similar(percent), "a long, b long, linked boolean")


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, list[tuple[int, int, int, int]]]]:
    """Whole groups of equal (key, i, j), which must come in this order, about `rows` rows at a time: their rows, and
    start, end, i and j of each."""
    held: list[pa.RecordBatch] = []
    marks: list[tuple] = []  # start and name
    size = 0

    def out() -> tuple[pa.Table, list[tuple[int, int, int, int]]]:
        ends = [m[0] for m in marks[1:]] + [size]
        return pa.Table.from_batches(held).combine_chunks(), [(m[0], e, m[1][1], m[1][2]) for m, e in zip(marks, ends, strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if not marks or tuple(ids[x].tolist()) != marks[-1][1]:
                if size >= rows:
                    yield out()
                    held, marks, size = [], [], 0
                marks.append((size, tuple(ids[x].tolist())))
            held.append(b.slice(x, y - x))
            size += y - x
    if marks:
        yield out()


def _pairs(block: np.ndarray, groups: list[tuple[int, int, int, int]], most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of block i with block j in each group, as places of rows, about `most` at a time."""
    xs, ys, n = [], [], 0
    for start, end, i, j in groups:
        if i == j:
            parts = [np.arange(start, end)] * 2
        else:
            parts = [start + np.flatnonzero(block[start:end] == k) for k in (i, j)]
        left, right = parts
        step = max(1, most // max(1, len(right)))
        for at in range(0, len(left), step):
            x, y = np.repeat(left[at : at + step], len(right)), np.tile(right, len(left[at : at + step]))
            if i == j:
                x, y = x[x < y], y[x < y]
            xs.append(x)
            ys.append(y)
            n += len(x)
            if n >= most:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(ys)


def _candidates(table: pa.Table, groups: list[tuple[int, int, int, int]], how: Signatures, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows in pairs, the most alike first: of different components, within the distance, of sizes that allow
    a link, and with no earlier key in common, so that a pair comes up under one key only."""
    block, component, size, place = (table.column(c).to_numpy() for c in ("block", "component", "n_shingles", "place"))
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16 if how.bits <= 16 else np.uint32).reshape(-1, how.size)
    for a, b in _pairs(block, groups):
        ok = (component[a] != component[b]) & (percent * np.maximum(size[a], size[b]) <= 100 * np.minimum(size[a], size[b]))
        a, b = a[ok], b[ok]
        differ = np.concatenate([np.zeros(0, np.int64), *((signature[a[k : k + 10_000]] != signature[b[k : k + 10_000]]).sum(1) for k in range(0, len(a), 10_000))])
        near = np.flatnonzero(differ <= how.distance)
        near = near[np.argsort(differ[near], kind="stable")]
        if len(near):
            a, b = a[near], b[near]
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = _long_keys(signature[used], how)
            first = np.concatenate([(keys[at[: len(a)][k : k + 10_000]] == keys[at[len(a) :][k : k + 10_000]]).argmax(1) for k in range(0, len(a), 10_000)]) == place[a]
            yield a[first], b[first]


def _active(how: Signatures, percent: int):
    """key and rep of the rows that have a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _groups(batches, 4096):
            found = np.zeros(table.num_rows, bool)
            for a, b in _candidates(table, groups, how, percent):
                found[a] = found[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[found]) for c in ("key", "rep")], ["key", "rep"])

    return run


def _linked(how: Signatures, percent: int):
    """Links on full sets between components; a pair that the links found here already join is not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _groups(batches, 512):
            above: dict[int, int] = {}

            def top(x: int, above: dict[int, int] = above) -> int:
                while (y := above.get(x, x)) != x:
                    above[x] = above.get(y, y)
                    x = y
                return x

            sets: list[np.ndarray] | None = None
            component, rep = table.column("component").to_pylist(), table.column("rep").to_pylist()
            links = []
            for xs, ys in _candidates(table, groups, how, percent):
                for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                    p, q = top(component[x]), top(component[y])
                    if p == q:
                        continue
                    if sets is None:
                        sets = [s for b in table.select(["text"]).to_batches(200) for s in shingle_sets(utf8(b.column(0)))]
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                        above[max(p, q)] = min(p, q)
                        links.append((rep[x], rep[y]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """rows (key, rep, ...) dealt to the pairings (i, j) of the blocks of their key; sizes: key and its rows n."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(sizes.select("key", blocks.alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, labels: DataFrame, how: Signatures, percent: int, block: int, text_block: int) -> DataFrame:
    """Links (a, b) between components, enough to join all that have one; signatures first, then texts where needed."""
    named = written(members.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named")
    sizes = named.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    signed = classes.select("rep", "signature", "n_shingles")
    active = _in_blocks(named.join(signed, "rep"), sizes, block).mapInArrow(_active(how, percent), "key long, rep long").distinct()
    active = written(active, "active")
    rows = active.join(named, ["key", "rep"]).join(signed, "rep").join(texts.toDF("rep", "text"), "rep")
    return _in_blocks(rows, active.groupBy("key").agg(F.count("*").alias("n")), text_block).mapInArrow(_linked(how, percent), "a long, b long")


def _united(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    edges = links.select("a", "b")
    if labels is not None:
        edges = edges.union(labels.select("rep", "component"))
    return written(components(edges).toDF("rep", "component"), "labels")


def near_duplicates(docs: DataFrame, how: Signatures = Signatures(), percent: int = 80, block: int = 4096, text_block: int = 512) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    block, text_block: about so many signatures, or texts, of one key are compared with as many in one go.
    """
    texts = docs.select("doc_id", "text")
    signed = written(texts.mapInArrow(_signed(how), "doc_id long, n_shingles long, set_key binary, signature binary"), "signed")
    sets = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
    classes = written(sets.agg(F.min("doc_id").alias("rep"), F.any_value("signature").alias("signature"), F.any_value("n_shingles").alias("n_shingles")), "classes")
    filed = classes.select("rep", "signature").mapInArrow(_filed(how), "rep long, keys array<long>").select(F.posexplode("keys").alias("place", "key"), "rep")
    centres = filed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre != last").select("key", "centre")
    members = written(filed.join(centres, "key"), "members")  # of keys with several classes
    met = members.where("rep != centre").groupBy("rep", "centre").count()
    pairs = written(met.groupBy("rep").agg(F.max_by("centre", F.struct("count", -F.col("centre"))).alias("centre")).select(F.col("centre").alias("a"), F.col("rep").alias("b")), "pairs")
    labels = _united(None, _confirmed(pairs, texts, percent).where("linked"))
    labels = _united(labels, _across(members.drop("centre"), classes, texts, labels, how, percent, block, text_block))
    ids = signed.join(classes.select("set_key", "rep"), "set_key", "left").join(labels, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")
    return ids.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, how: Signatures = Signatures()) -> DataFrame:  # noqa: B008
    """The rows of docs without all but the least doc_id of each component, and without repeats of one doc_id and text; rows
    without a doc_id stay."""
    gone = near_duplicates(docs, how).where("not kept").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)


ORACLE = r"""
with d as (select doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') w0 from documents),
e as (select doc_id, case when w0 = [''] then [] else w0 end w from d),
s as (select distinct doc_id, array_to_string(w[p:p + 3], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) p from e where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as materialized (select a, b from l union select b, a from l),
r as (with recursive reach(x, y) as (select a, b from both_ways union select reach.x, both_ways.b from reach join both_ways on reach.y = both_ways.a) select x, min(y) m from reach group by x)
select doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(m, doc_id)) component_id, least(doc_id, coalesce(m, doc_id)) = doc_id kept
from documents left join n using (doc_id) left join r on x = doc_id"""
