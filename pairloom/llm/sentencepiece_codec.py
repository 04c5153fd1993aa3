"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reports, at each end position, every piece that ends there (its output links), and each
report relaxes the best score of that position. Where no piece has a space mark after another character, or ASCII signs
after a Latin letter, a text falls apart at such places, and the parts are solved once and remembered.
Among segmentations of equal score the one whose last piece is longest wins, from the end backwards. Characters
without a piece become bytes. A null or empty text has no tokens. Encoding is lossless: decoding gives the same text,
literal space marks (U+2581) included. Repeated rows are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.words import slices

MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    """pieces: (text, score, id) of the normal ones; byte_ids: the ids of the 256 bytes."""

    pieces: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        return cls(tuple((model.id_to_piece(i), model.get_score(i), i) for i in ids if not special(i)), tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256)))

    @cached_property
    def unknown_score(self) -> float:
        return min((s for _, s, _ in self.pieces), default=0.0) - 10.0

    def table(self) -> dict[int, bytes]:
        return {i: p.replace(MARK, " ").encode() for p, _, i in self.pieces} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


class Encoder:
    """remember: parts of at most `short` characters are kept up to so many characters twice over, which bounds the memory of
    a worker: when there are more, those that haven't been met since the last such time are forgotten."""

    #: A part ends before a space mark that follows another character, and between a Latin letter and ASCII that is none.
    _latin, _sign = "A-Za-z\u00c0-\u024f", r"!-@\[-`{-~"
    _run = f"(?:[{_latin}]+(?:[^{MARK}{_latin}{_sign}][^{MARK}{_latin}]*)?)"
    _parts = re.compile(f"{MARK}+[^{MARK}{_latin}]*{_run}*|[^{MARK}{_latin}]+{_run}*|{_run}+")
    _no_piece = re.compile(f"[^{MARK}]{MARK}|[{_latin}][{_sign}]")

    def __init__(self, pieces: Pieces, remember: int = 3_000_000, short: int = 64):
        import ahocorasick

        self.pieces, self.remember, self.short, self.held, self.known, self.older = pieces, remember, short, 0, {}, {}
        self.automaton = ahocorasick.Automaton()
        for text, score, i in pieces.pieces:
            self.automaton.add_word(text, (len(text), score, i))
        self.automaton.make_automaton()
        self.single = {text for text, _, _ in pieces.pieces if len(text) == 1}
        whole = any(self._no_piece.search(text) for text, _, _ in pieces.pieces)
        self._part = re.compile(".+", re.S) if whole else self._parts
        self.bytes = np.array(pieces.byte_ids, np.int32)

    def viterbi(self, part: str) -> list[int]:
        """The ids of the best segmentation of part, in one pass over the automaton's reports."""
        n, unknown, single = len(part), self.pieces.unknown_score, self.single
        best, back, done = [0.0] + [-np.inf] * n, [None] * (n + 1), 0

        def fall_back(until: int) -> None:
            nonlocal done
            while done < until:  # a character without a piece of its own may stand alone, as bytes
                if part[done] not in single and best[done] + unknown > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + unknown, (done, -1)
                done += 1

        for end, (size, score, i) in self.automaton.iter(part):
            fall_back(end + 1)
            start = end + 1 - size
            if (s := best[start] + score) > best[end + 1] or s == best[end + 1] and back[end + 1] is not None and start < back[end + 1][0]:
                best[end + 1], back[end + 1] = s, (start, i)
        fall_back(n)
        out: list[int] = []
        while n:
            start, i = back[n]
            out += [i] if i >= 0 else self.bytes[list(part[start:n].encode())].tolist()[::-1]
            n = start
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        found, known = [], self.known
        for k, stretch in enumerate(text.split(MARK)):
            if k:
                found.append(self.bytes[list(MARK.encode())].tobytes())
            escaped = stretch.replace(" ", MARK)
            for part in self._part.findall(escaped if k else MARK + escaped):
                ids = known.get(part)
                if ids is None:
                    ids = self.older.get(part)
                    if ids is None:
                        ids = np.array(self.viterbi(part), np.int32).tobytes()
                    if len(part) <= self.short:
                        if self.held >= self.remember:
                            self.older, self.known, self.held = known, (known := {}), 0
                        self.held += len(part)
                        known[part] = ids
                found.append(ids)
        return np.frombuffer(b"".join(found), np.int32)


class Decoder:
    def __init__(self, pieces: Pieces):
        self.table = pieces.table()

    def decode(self, ids) -> str:
        """The text; unknown ids stand for nothing."""
        table = self.table
        return b"".join([table.get(i, b"") for i in ids]).decode(errors="replace")[1:]


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip (whether decoding gives the text again) for each row of docs."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary.value), Decoder(vocabulary.value)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            ids = [encoder.encode(t) for t in texts]
            same = [decoder.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(i) for i in ids], np.int64)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), lists, pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id and text for each row of tokens (doc_id, token_ids); null ids give an empty text."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for b in slices(batches):
            texts = [decoder.decode(ids or ()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
