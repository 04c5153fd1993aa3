"""Runs of words: stretches that repeat with one period and that no neighbouring word carries on (Kolpakov and Kucherov).

A text's words are numbered and factorised by a suffix automaton: each factor is a new word or the longest piece that began
earlier. A run either touches a border between factors or lies inside a factor. The first kind is found at each border by
Main's algorithm, from common prefixes and suffixes (Z arrays) of windows whose sizes are bounded by the two factors, so the
work is linear in the text. The second kind is copied from where the factor occurred before, in the order of starts.

Where only runs of some repetitions are asked for, the text is first cut where no such run can pass: in a run of `times`
periods each sequence of three words stands at least `times` - 1 times, so a text parts at words whose sequence is rarer.
Counts are taken again inside each piece until nothing parts. Words are told by numbers of their own; only the counts of
sequences use hashes, and a collision makes pieces longer, never shorter.

Null and empty texts have no words and no runs. A text of any length is one task's row: memory grows with the longest piece
that repeats, not with the table. Ties, repeated rows and rows without a doc_id are nothing special: each row is looked at by
itself. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import mixed, slices, spaced_words, utf8

Run = tuple[int, int, int]  # start, length and least period

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def factors(words: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of each factor; -1 for a new word. An earlier piece may reach into its factor.

    States of the suffix automaton know where their strings end first, so a piece occurred earlier just if its state's first
    end lies before the piece's own.
    """
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(words):
        now = len(step)
        step.append({})
        link.append(0)
        length.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    found, i, n = [], 0, len(words)
    while i < n:
        state, j = 0, i
        while j < n:
            # a piece's state exists, since the automaton knows the whole text
            after = step[state][words[j]]
            if first[after] >= j:
                break
            state, j = after, j + 1
        if j == i:
            found.append((i, 1, -1))
            i += 1
        else:
            found.append((i, j - i, first[state] - (j - i) + 1))
            i = j
    return found


def z_array(s: Sequence[int]) -> list[int]:
    """The length of the longest common prefix of s and s[i:], for each i."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(words: list[int], low: int, border: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions of two periods or more within words[low:high] that touch the border."""
    x, y = words[low:border], words[border:high]
    m, n = len(x), len(y)
    back = x[::-1]
    ahead = z_array(y)  # of y and y[p:]
    behind = z_array([*back, -1, *words[low:high][::-1]])  # of x and x + y[:p], from their ends
    for p in range(1, n + 1):
        more = ahead[p] if p < n else 0
        less = behind[m + 1 + n - p]
        if less + more >= p:
            yield border - less, border + p + more, p
    across = z_array([*y, -1, *x, *y])  # of y and x[-p:] + y
    before = z_array(back)  # of x and x[:-p], from their ends
    for p in range(1, m + 1):
        more = across[n + 1 + m - p] if n else 0
        less = before[p] if p < m else 0
        if less + more >= p:
            yield border - p - less, border + more, p


def all_runs(words: list[int], least: int = 2, times: int = 2) -> list[Run]:
    """The runs of at least `least` words and `times` periods, `times` 2 or more, by start and period. Words are numbers from 0."""
    n = len(words)
    parts = factors(words)
    starts: dict[int, dict[int, int]] = {}  # start to end to least period
    before = 0
    for k, (begin, size, _) in enumerate([*parts, (n, 0, -1)]):
        # a run that ends in this factor and touches its beginning starts in the window
        low = max(0, begin - 2 * before - size - 1)
        high = min(n, begin + size + 1)  # one word more tells whether a run goes on
        if k:
            for s, e, p in _at_border(words, low, begin, high):
                if e - s < max(least, times * p) or (s == low and s and words[s - 1] == words[s - 1 + p]) or (e == high < n and words[e] == words[e - p]):
                    continue
                own = starts.setdefault(s, {})
                own[e] = min(own.get(e, p), p)
        before = size
    for begin, size, earlier in parts:
        if earlier < 0 or size < least:
            continue
        shift, end = begin - earlier, earlier + size
        for s in range(earlier + 1, end - 1):
            for e, p in tuple(starts.get(s, {}).items()):
                if e < end:
                    starts.setdefault(s + shift, {}).setdefault(e + shift, p)
    return sorted((s, e - s, p) for s, own in starts.items() for e, p in own.items())


def least_count(width: int, least: int, times: int) -> int:
    """How often at least each sequence of `width` words of a run stands in it."""
    return min(times - 1, *((max(least, times * q) - width + 1) // q for q in range(1, width)))


def pieces(codes: np.ndarray, owners: np.ndarray, least: int, times: int, width: int = 3) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of the stretches of codes, words of one owner, that hold all runs asked for."""
    most = least_count(width, least, times)
    begins = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else np.zeros(0, np.int64)
    ends = np.r_[begins[1:], len(owners)] if len(owners) else begins
    while most >= 2 and len(begins):
        fit = ends - begins >= least
        begins, ends = begins[fit], ends[fit]
        if not len(begins):
            break
        # places where a sequence of `width` words begins, piece by piece
        sizes = ends - begins - width + 1
        piece = np.repeat(np.arange(len(begins)), sizes)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[piece]
        h = mixed(piece.astype(np.uint64) + np.uint64(1))
        for k in range(width):
            h = mixed(h ^ codes[at + k].astype(np.uint64))
        group = pd.factorize(h)[0]
        kept = np.bincount(group)[group] >= most
        if kept.all():
            break
        # pieces are stretches of kept places, and the words of their last sequence
        at, piece = at[kept], piece[kept]
        if not len(at):
            return
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])])
        begins, ends = at[new], np.r_[at[new[1:] - 1], at[-1]] + width
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b >= least:
            yield b, e


def _found(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [spaced_words(t) for t in utf8(batch.column(1))]
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.empty(int(sizes.sum()), object)
        flat[:] = [w for t in texts for w in t]
        codes = pd.factorize(flat)[0] if len(flat) else np.zeros(0, np.int64)
        first = np.cumsum(sizes) - sizes
        owners = np.repeat(np.arange(len(texts)), sizes)
        runs: list[list[Run]] = [[] for _ in texts]
        for b, e in pieces(codes, owners, least, times):
            k = int(owners[b])
            runs[k] += [(b - int(first[k]) + s, length, p) for s, length, p in all_runs(codes[b:e].tolist(), least, times)]
        collapsed = []
        for words, own in zip(texts, runs, strict=True):
            own.sort(key=lambda r: (r[0], r[2]))
            if own:
                gone = np.zeros(len(words) + 1, np.int64)
                for s, length, p in own:
                    gone[s + p] += 1
                    gone[s + length] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            collapsed.append(b" ".join(words).decode())
        flat_runs = [r for own in runs for r in own]
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        structs = pa.StructArray.from_arrays([pa.array([r[k] for r in flat_runs], pa.int64()) for k in range(3)], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each run of at least `least` words and `times` periods, by start
    and period) and collapsed (the words but those after the first period of a run, with one space between) of docs
    (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_found, least=least, times=times), SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """found as one flat row a document: how many runs, the longest one and its repetitions, and hashes of all runs and of the
    collapsed text. Of runs of one length the first counts, of those the one of the least period; without runs it is null."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    told = found.withColumns({"longest": longest, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
