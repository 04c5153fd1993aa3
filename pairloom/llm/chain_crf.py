"""Linear-chain conditional random fields over numbered features, in numpy: training, marginals and Viterbi.

A token's features are column numbers; sequences are short-lived arrays inside a task, or a bounded training sample.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

#: Feature names are hashed into so many columns.
WIDTH = 4096


class Columns:
    """Feature names to hashed columns, remembered while there are few."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, names: list[str]) -> list[int]:
        if len(self.known) > 50_000:
            self.known.clear()
        return [self.known[n] if n in self.known else self.known.setdefault(n, self._column(n)) for n in names]

    @staticmethod
    def _column(name: str) -> int:
        return int.from_bytes(hashlib.blake2b(name.encode(errors="surrogatepass"), digest_size=4).digest(), "little") % WIDTH


class Covered:
    """The union of some half-open spans."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


@dataclass
class Flat:
    """Sequences as one run of tokens: features of token i are columns[starts[i]:starts[i + 1]]."""

    columns: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, sequences: Sequence[Sequence[Sequence[int]]]) -> Flat:
        tokens = [t for s in sequences for t in s]
        columns = np.array([c for t in tokens for c in t], np.int64)
        return cls(columns, np.cumsum([0, *map(len, tokens)]), np.array([len(s) for s in sequences], np.int64))


@dataclass
class Chain:
    """weights: features by labels; transitions: label before by label after.

    held: the tokens before and after each sequence are known to have label 0, as where a sequence is cut out of a text.
    """

    weights: np.ndarray
    transitions: np.ndarray
    held: bool = False

    def emissions(self, flat: Flat) -> np.ndarray:
        """Each token's sum of weights; it depends on no other token."""
        out = np.zeros((len(flat.starts) - 1, self.weights.shape[1]))
        some = np.diff(flat.starts) > 0
        if some.any():
            out[some] = np.add.reduceat(self.weights[flat.columns], flat.starts[:-1][some], axis=0)
        return out

    def bounded(self, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Emissions with what the tokens around each sequence add to its first and last one."""
        if not self.held:
            return e
        e = e.copy()
        e[first] += self.transitions[0]
        e[last] += self.transitions[:, 0]
        return e

    def marginals(self, flat: Flat) -> np.ndarray:
        """Each token's probabilities of the labels, by forward-backward."""
        return self._passes(flat, self.emissions(flat))[0]

    def _passes(self, flat: Flat, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals, expected transitions and log-partition, sequences of like length side by side."""
        k, out, pairs, z_all = e.shape[1], np.zeros_like(e), np.zeros((e.shape[1],) * 2), 0.0
        first = np.cumsum(flat.lengths) - flat.lengths
        some = flat.lengths > 0
        e = self.bounded(e, first[some], (first + flat.lengths - 1)[some])
        for n in np.unique(flat.lengths[flat.lengths > 0]):
            at = first[flat.lengths == n]
            forward, backward = np.zeros((n, len(at), k)), np.zeros((n, len(at), k))
            forward[0] = e[at]
            for t in range(1, n):
                forward[t] = e[at + t] + _logsum(forward[t - 1][:, :, None] + self.transitions[None], 1)
            for t in range(n - 2, -1, -1):
                backward[t] = _logsum(self.transitions[None] + (e[at + t + 1] + backward[t + 1])[:, None, :], 2)
            z = _logsum(forward[n - 1], 1)
            z_all += z.sum()
            for t in range(n):
                out[at + t] = np.exp(forward[t] + backward[t] - z[:, None])
                if t + 1 < n:
                    pairs += np.exp(forward[t][:, :, None] + self.transitions[None] + (e[at + t + 1] + backward[t + 1])[:, None, :] - z[:, None, None]).sum(0)
        if self.held:
            pairs[0] += out[first[some]].sum(0)
            pairs[:, 0] += out[(first + flat.lengths - 1)[some]].sum(0)
        return out, pairs, z_all

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best labels of one sequence of emissions; the lower label wins ties."""
        if not len(e):
            return []
        e = self.bounded(e, np.array([0]), np.array([len(e) - 1]))
        best, back = e[0], []
        for row in e[1:]:
            scores = best[:, None] + self.transitions
            back.append(scores.argmax(0))
            best = scores.max(0) + row
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


def train(flat: Flat, labels: np.ndarray, features: int, kinds: int, *, weights: np.ndarray | None = None, held: bool = False, l2: float = 0.01, steps: int = 120, rate: float = 0.15) -> Chain:
    """Maximum likelihood with a quadratic penalty, by full-batch Adam. weights: one for each sequence.

    Without sequences, all weights are 0.
    """
    model = Chain(np.zeros((features, kinds)), np.zeros((kinds, kinds)), held)
    n = len(labels)
    if not n:
        return model
    of_token = np.repeat(np.arange(len(flat.lengths)), flat.lengths)
    each = np.ones(len(flat.lengths)) if weights is None else weights
    followed = np.flatnonzero(of_token[1:] == of_token[:-1])
    true = np.eye(kinds)[labels]
    counted = np.zeros((kinds, kinds))
    np.add.at(counted, (labels[followed], labels[followed + 1]), 1.0)
    if held:
        some = flat.lengths > 0
        first = (np.cumsum(flat.lengths) - flat.lengths)[some]
        np.add.at(counted[0], labels[first], 1.0)
        np.add.at(counted[:, 0], labels[first + flat.lengths[some] - 1], 1.0)
    per = np.diff(flat.starts)
    token_of_column = np.repeat(np.arange(n), per)
    state = [np.zeros_like(x) for x in (model.weights, model.transitions, model.weights, model.transitions)]
    for step in range(1, steps + 1):
        p, pairs, _ = model._passes(flat, model.emissions(flat))
        off = (p - true) * each[of_token][:, None]
        slope = np.stack([np.bincount(flat.columns, weights=off[token_of_column, c], minlength=features) for c in range(kinds)], 1)
        slopes = [slope / n + l2 * model.weights / features**0.5, (pairs - counted) / n + l2 * model.transitions]
        for i, (x, g) in enumerate(zip((model.weights, model.transitions), slopes, strict=True)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 2] = 0.99 * state[i + 2] + 0.01 * g * g
            x -= rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 2] / (1 - 0.99**step)) + 1e-8)
    return model
