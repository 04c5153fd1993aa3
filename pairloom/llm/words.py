"""Words and 64-bit hashes of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z; everything that is no letter, digit or non-ASCII byte to a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [b or b"" for b in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Runs without the six ASCII white-space characters, which are just those that bytes.split() splits at."""
    return text.split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, of about `size` bytes of texts unless a single row has more, so that a task holds little
    at a time."""
    for b in batches:
        ends = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                ends += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(ends), 0
        while at < b.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(at + rows, max(most, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (Steele and others' finalizer)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
