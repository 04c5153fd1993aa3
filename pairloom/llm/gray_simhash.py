"""Near-duplicates by SimHash, linked through a hierarchical index in Gray order.

A fingerprint's bit is 1 if it is set in over half of the 64-bit hashes of a text's 3-word shingles. Fingerprints are sorted
by Gray rank, the place of a number in the reflected Gray code, so neighbours in the order share most bits. Each range of the
order is a node of the index: the bits that all its fingerprints share are its mask and its pattern. Inside a node stands a
tree of the same kind: upper nodes hold the bits that all below them share, lower ones only what is new, down to fingerprints.
A search goes down the levels with the differences met so far and drops a whole group once they exceed the distance.

First each range is searched against itself inside one task, which joins its fingerprints to parts. Then each fingerprint is
sent to those other ranges whose pattern it may match (the table of patterns, of at most `most_nodes` rows of 16 bytes, is
broadcast; of two ranges only one asks the other), and streams past the tree of the range there, dealt over several tasks a
range. A link between two parts that the task has already joined is not written again, so no list of pairs arises. Parts and
links between them make the components.

Equal fingerprints are one from the start. Null and empty texts have no shingles and fingerprint zero, and are linked like any
other; texts of fewer than 3 words have one shingle. Rows without a doc_id take a fingerprint but no part in links, and have no
component. Repeated rows are linked with each other; the component is the least doc_id, so there are no ties. No rows give no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.words import slices, utf8
from pairloom.sources.tables import written

SEED = 42


def shingle_hashes(text: bytes, n: int = 3) -> np.ndarray:
    """XXH64 of each n-word shingle of the lower-cased text, with repeats; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([hashed(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: -n] + 1].tolist()
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = np.array([fingerprint(shingle_hashes(t)) for t in utf8(b.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])


def gray_rank(fingerprint: str | Column) -> Column:
    """The place of an unsigned 64-bit number, given as a long, in the reflected Gray code, as a long that sorts the same."""
    x = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(2**63)))


class GrayTree:
    """Patterns in Gray order with levels of nodes over them, each over `fan` of the level below.

    bits, masks: of each pattern, the bits that are told and which those are (all of them by default). A node's mask has the
    bits that all below it tell alike; each level keeps only the bits that the level above doesn't have.
    """

    def __init__(self, bits: np.ndarray, masks: np.ndarray | None = None, fan: int = 16):
        self.fan = fan
        level_bits = [np.asarray(bits, np.uint64)]
        level_masks = [np.full(len(bits), ~np.uint64(0)) if masks is None else np.asarray(masks, np.uint64)]
        while len(level_bits[-1]) > fan:
            b, m = level_bits[-1], level_masks[-1]
            at = np.arange(0, len(b), fan)
            ones = np.bitwise_and.reduceat(b | ~m, at)
            zeros = np.bitwise_and.reduceat(~b | ~m, at)
            level_masks.append(np.bitwise_and.reduceat(m, at) & (ones | zeros))
            level_bits.append(ones & level_masks[-1])
        self.bits, self.masks = level_bits, [m.copy() for m in level_masks]
        for k in range(len(level_masks) - 1):
            self.masks[k] &= ~np.repeat(level_masks[k + 1], fan)[: len(level_masks[k])]

    def search(self, queries: np.ndarray, distance: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of patterns that differ in at most `distance` told bits, some at a time; at most about `most`
        nodes are held at once on each level."""
        top = len(self.bits) - 1
        step = max(1, most // max(1, len(self.bits[top])))
        for k in range(0, len(queries), step):
            q = np.arange(k, min(k + step, len(queries)))
            n = len(self.bits[top])
            yield from self._down(queries, distance, most, top, np.repeat(q, n), np.tile(np.arange(n), len(q)), np.zeros(len(q) * n, np.uint8))

    def _down(self, queries: np.ndarray, distance: int, most: int, level: int, q: np.ndarray, node: np.ndarray, so_far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        met = so_far + np.bitwise_count((queries[q] ^ self.bits[level][node]) & self.masks[level][node])
        near = met <= distance
        q, node, met = q[near], node[near], met[near]
        if level == 0:
            if len(q):
                yield q, node
            return
        below = len(self.bits[level - 1])
        for k in range(0, len(q), step := max(1, most // self.fan)):
            part = slice(k, k + step)
            child = (node[part, None] * self.fan + np.arange(self.fan)).ravel()
            there = child < below
            yield from self._down(queries, distance, most, level - 1, np.repeat(q[part], self.fan)[there], child[there], np.repeat(met[part], self.fan)[there])


class _Parts:
    """Which labels have been joined; the least of a part names it."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def _joined(tree: GrayTree, queries: np.ndarray, asking: np.ndarray, answering: np.ndarray, distance: int, parts: _Parts) -> Iterator[tuple[int, int]]:
    """Pairs of labels that matches newly join. Labels are looked up once for each pair of them and batch of matches."""
    for q, m in tree.search(queries, distance):
        a, b = asking[q], answering[m]
        differ = a != b
        if differ.any():
            for x, y in np.unique(np.stack([a[differ], b[differ]], 1), axis=0).tolist():
                if parts.join(x, y):
                    yield x, y


def _columns(batches: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    return [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in batches]) for n in names]


def _within(distance: int):
    """The range that the task holds, as one node: each fingerprint with the least rep of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        fingerprints, reps = _columns(held, "fingerprint", "rep")
        bits, parts = fingerprints.view(np.uint64), _Parts()
        for _ in _joined(GrayTree(bits), bits, reps, reps, distance, parts):
            pass
        least = np.array([parts.top(x) for x in reps.tolist()], np.int64)
        node = np.full(len(reps), TaskContext.get().partitionId(), np.int32)
        for k in range(0, len(reps), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 10_000]) for c in (node, fingerprints, least)], ["node", "fingerprint", "part"])

    return run


def _sent(nodes: np.ndarray, bits: np.ndarray, masks: np.ndarray, distance: int, tasks: int):
    """Each fingerprint once for each other node that it may match; of two nodes, the one with an odd sum of numbers asks
    upwards. Members go to all tasks of their own node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = GrayTree(bits, masks)
        names = ["node", "task", "asks", "fingerprint", "part"]
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                b = batch.slice(k, 2048)
                own, fingerprints, part = _columns([b], "node", "fingerprint", "part")
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, tasks)), pa.array(np.tile(np.arange(tasks, dtype=np.int32), n)), pa.array(np.zeros(n * tasks, bool)), pa.array(np.repeat(fingerprints, tasks)), pa.array(np.repeat(part, tasks))], names)
                task = ((fingerprints.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % tasks
                for q, m in tree.search(fingerprints.view(np.uint64), distance):
                    there = nodes[m]
                    asks = (there != own[q]) & ((own[q] < there) == ((own[q] + there) % 2 == 1))
                    q, there = q[asks], there[asks]
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(task[q].astype(np.int32)), pa.array(np.ones(len(q), bool)), pa.array(fingerprints[q]), pa.array(part[q])], names)

    return run


def _across(distance: int):
    """Links (a, b) between parts. Rows come by node and task, members before those that ask, which stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, tree, answering, parts = None, None, None, _Parts()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "task", "asks")], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                now, rows = tuple(ids[x, :2].tolist()), batch.slice(x, y - x)
                if now != group:
                    group, held, tree, parts = now, [], None, _Parts()
                if not ids[x, 2]:
                    held.append(rows)
                    continue
                if tree is None:
                    members, answering = _columns(held, "fingerprint", "part")
                    tree = GrayTree(members.view(np.uint64))
                queries, asking = _columns([rows], "fingerprint", "part")
                links = list(_joined(tree, queries.view(np.uint64), asking, answering, distance, parts))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def linked(classes: DataFrame, distance: int = 3, size: int = 8192, most_nodes: int = 65_536, tasks: int = 8) -> DataFrame:
    """fingerprint and component_id (the least rep reachable) of classes (fingerprint, rep), whose fingerprints are distinct.

    size: about so many fingerprints a range at least; more, where there would be over most_nodes ranges.
    """
    ranges = max(1, min(most_nodes, -(-classes.count() // size)))
    ranked = classes.select("fingerprint", "rep", gray_rank("fingerprint").alias("rank")).repartitionByRange(ranges, "rank").sortWithinPartitions("rank")
    nodes = written(ranked.mapInArrow(_within(distance), "node int, fingerprint long, part long"), "nodes")
    both, either = F.expr("bit_and(fingerprint)"), F.expr("bit_or(fingerprint)")
    # a row a range: at most most_nodes
    patterns = nodes.groupBy("node").agg(both.alias("bits"), F.bitwise_not(both.bitwiseXOR(either)).alias("mask")).orderBy(gray_rank("bits")).toPandas()
    if len(patterns) > 1:
        number, bits, masks = patterns["node"].to_numpy(np.int32), patterns["bits"].to_numpy(np.int64).view(np.uint64), patterns["mask"].to_numpy(np.int64).view(np.uint64)
        sent = nodes.mapInArrow(_sent(number, bits, masks, distance, tasks), "node int, task int, asks boolean, fingerprint long, part long")
        links = sent.repartition("node", "task").sortWithinPartitions("node", "task", "asks").mapInArrow(_across(distance), "a long, b long")
        joined = components(links).withColumnRenamed("node", "part")
        nodes = nodes.join(joined, "part", "left").withColumn("part", F.coalesce("component", "part"))
    return nodes.select("fingerprint", F.col("part").alias("component_id"))


def near_duplicates(docs: DataFrame, distance: int = 3, **index: int) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of docs (doc_id, text).

    index: size, most_nodes and tasks of `linked`.
    """
    told = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fingerprint long"), "fingerprints")
    classes = written(told.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    found = told.join(linked(classes, distance, **index), "fingerprint", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), component)
