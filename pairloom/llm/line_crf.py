"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

A line's features are bins of its own statistics and of its neighbours'; training lines carry the label of their
document. The marginal of "good", weighted by the lines' bytes, is a document's raw score, and a logistic curve
fitted on the same labelled rows turns it into a probability. Null and empty texts are one line without words.
Repeated rows get the same score each; other columns are ignored. A doc_id with several labels counts with its
lowest quality. Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.chain_crf import Chain, Flat, train
from pairloom.llm.sampling import bounded_sample
from pairloom.llm.words import slices, utf8

_SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.16, 0.3, 0.5, 0.75])
_SIZES = np.array([0.0, 1, 2, 4, 8, 16, 40, 120])
_MEANS = np.array([2.0, 3, 4, 5, 6, 8, 12])
#: Bins of each statistic: words, mean word, symbols, upper case, digits, exclamation, bars, distinct words, full stop at the end, seen before in the text, longest run of one word.
EDGES = (_SIZES, _MEANS, _SHARES, _SHARES, _SHARES, _SHARES, _SHARES, _SHARES, np.array([0.5]), np.array([0.5]), np.array([1.0, 2, 3, 5, 8]))
_WIDTH = 9
FEATURES = 3 * len(EDGES) * _WIDTH + 3
_KEEP = {name: bytes(c for c in range(256) if c not in set(chars)) for name, chars in (("symbol", b"#*$%&<>~^_=+{}[]\\"), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("exclaim", b"!?"), ("bar", b"|"))}


def lines_of(text: bytes) -> list[bytes]:
    """The lines that have words; at least one."""
    return [x for x in text.split(b"\n") if x.strip()] or [b""]


def statistics(lines: list[bytes]) -> np.ndarray:
    out, before = np.zeros((len(lines), len(EDGES))), set()
    for i, line in enumerate(lines):
        words = line.split()
        n, chars = len(words), sum(map(len, words)) or 1
        share = lambda name, line=line, chars=chars: len(line.translate(None, _KEEP[name])) / chars
        run = longest = 1 if words else 0
        if n - len(set(words)) >= 2:
            for a, b in zip(words, words[1:], strict=False):
                run = run + 1 if a == b else 1
                longest = max(longest, run)
        upper = line.decode(errors="replace")
        capital = sum(map(str.isupper, upper)) / chars if not line.isascii() else share("upper")
        out[i] = n, chars / n if n else 0, share("symbol"), capital, share("digit"), share("exclaim"), share("bar"), len(set(words)) / n if n else 0, line.rstrip()[-1:] in (b".", b"!", b"?"), line in before, longest
        before.add(line)
    return out


def features(lines: list[bytes]) -> np.ndarray:
    """Feature columns of each line: own bins, the lines' before and after, and a constant."""
    stats = statistics(lines)
    bins = np.stack([np.digitize(stats[:, j], e, right=True) + j * _WIDTH for j, e in enumerate(EDGES)], 1)
    width, n = len(EDGES) * _WIDTH, len(lines)
    none = np.full((1, bins.shape[1]), -1)
    before = np.concatenate([none, bins[:-1]])
    after = np.concatenate([bins[1:], none])
    before, after = (np.where(x >= 0, x + k * width, 3 * width + k) for k, x in ((1, before), (2, after)))
    return np.concatenate([bins, before, after, np.full((n, 1), 3 * width)], 1)


@dataclass
class Model:
    chain: Chain
    slope: float = 1.0
    offset: float = 0.0

    def score(self, texts: list[bytes]) -> list[float]:
        lines = [lines_of(t) for t in texts]
        marks = [features(x) for x in lines]
        good = self.raw(marks, [[max(1, len(x)) for x in y] for y in lines])
        return (1 / (1 + np.exp(-np.clip(self.slope * _logit(good) + self.offset, -30, 30)))).tolist()

    def raw(self, marks: list[np.ndarray], sizes: list[list[int]]) -> np.ndarray:
        width = marks[0].shape[1] if marks else 1
        lengths = np.array([len(m) for m in marks], np.int64)
        columns = np.concatenate([np.zeros((0, width), np.int64), *marks]).astype(np.int64)
        p = self.chain.marginals(Flat(columns.ravel(), np.arange(len(columns) + 1) * width, lengths))[:, 1]
        weight, ends = np.concatenate([np.zeros(0), *sizes]), np.cumsum(lengths)
        total = lambda x: np.add.reduceat(x, ends - lengths) if len(ends) else np.zeros(0)  # noqa: E731  a text has a line at least
        return total(p * weight) / total(weight)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        lines = [lines_of(t) for t in utf8(b.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [b.column("quality"), pa.array([features(x).ravel().tolist() for x in lines], pa.list_(pa.int32())), pa.array([[max(1, len(x)) for x in y] for y in lines], pa.list_(pa.int32()))], ["quality", "marks", "sizes"]
        )


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 3_000) -> Model:
    """A model from at most max_rows labelled documents, chosen by a hash of doc_id; only their numbers reach the driver."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(one, "doc_id", max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("quality"))
    rows = sample.mapInArrow(_marked, "quality int, marks array<int>, sizes array<int>").collect()
    rows.sort(key=lambda r: (r.quality, r.marks))  # so that the order of partitions doesn't matter
    width = 3 * len(EDGES) + 1
    marks, good = [np.array(r.marks, np.int64).reshape(-1, width) for r in rows], np.array([r.quality for r in rows], float)
    if not len(rows) or good.min() == good.max():
        return Model(Chain(np.zeros((FEATURES, 2)), np.zeros((2, 2))), 0.0, 0.0 if not len(rows) else (6.0 if good[0] else -6.0))
    columns, lengths = np.concatenate(marks), np.array([len(m) for m in marks], np.int64)
    flat = Flat(columns.ravel(), np.arange(len(columns) + 1) * width, lengths)
    model = Model(train(flat, np.repeat(good.astype(int), lengths), FEATURES, 2))
    x = _logit(model.raw(marks, [r.sizes for r in rows]))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps for the logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, p - good
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(g * x).sum() + (a - 1), g.sum()]))
        a, b = a - step[0], b - step[1]
    return Model(model.chain, float(a), float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for each row of docs (doc_id, text). The model is a few hundred numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = sent.value.score(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")

