"""Texts of an Arrow batch as NumPy arrays: bytes, words, hashes of word runs.

All hashes are polynomials over the ring of 64-bit integers, so that the hash of
any run of bytes or words comes from two prefix sums, followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose result bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd number and of its inverse, extended as needed."""

    def __init__(self, base: int):
        self._base, self._inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def ready(self, n: int) -> Powers:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            steps = np.full(n, self._base)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self._inverse
            self.down = np.multiply.accumulate(steps)
        return self


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BYTES_BASE = Powers(0x5851F42D4C957F2D)
WORDS_BASE = Powers(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prefix_sums(values: np.ndarray, base: Powers) -> np.ndarray:
    base.ready(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * base.up[: len(values)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: Powers) -> np.ndarray:
    """Hash of each run ``[start, end)`` of the values behind ``sums``; its length counts too."""
    raw = (sums[end] - sums[start]) * base.down[start]
    return mix(raw + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of the texts; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words of several texts: byte range and hash of each, and each text's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of bytes other than space and 9 to 13; with A-Z lowered if asked."""
    data, at = text_bytes(column)
    if lower:
        data = LOWER[data]
    inner = ~SPACE[data]
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    ends[:-1] &= ~inner[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] = inner[edge]
    ends[edge - 1] = inner[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums(BYTE_CODES[data], BYTES_BASE)
    return Words(data, start, end, run_hash(sums, start, end, BYTES_BASE), np.searchsorted(start, at))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
