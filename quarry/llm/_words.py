"""Vectorised words and fingerprints over Arrow text columns.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. Those six are
ASCII, so the work is done on UTF-8 bytes: byte positions of the words of many
documents come from a few numpy passes, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are handled at once; a longer document is handled alone.
SLICE_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For normalised tokens: all ASCII but letters and digits separates.
SEPARATES = np.ones(256, bool)
SEPARATES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values of a seed."""
    return mix(U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Rolling:
    """Polynomial fingerprints mod 2**64 of any run of an array, by prefix sums."""

    def __init__(self, multiplier: int):
        self.step, self.back = multiplier, pow(multiplier, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, U64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            for name, factor in (("powers", self.step), ("inverses", self.back)):
                grown = np.full(size, U64(factor))
                grown[0] = 1
                setattr(self, name, np.cumprod(grown, dtype=U64))

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A fingerprint of ``values[s:e]`` for each pair; equal runs agree wherever they lie."""
        self._reach(len(values) + 1)
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.powers[: len(values)], dtype=U64, out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverses[starts] + (ends - starts).astype(U64))


@lru_cache(None)
def rolling(multiplier: int) -> Rolling:
    return Rolling(multiplier)


@lru_cache(None)
def byte_codes(lower: bool) -> np.ndarray:
    codes = stream(0x51ED270B, 256)
    return codes[LOWER] if lower else codes


class Texts:
    """The words of a slice of documents.

    ``starts``/``ends``: byte positions of each word in ``data``; ``first``: index of
    each document's first word, with the total behind the last.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE):
        self.data, self.offsets = data, offsets
        gap = white[data]
        before, edge = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
        before[1:], edge[:-1] = gap, gap
        before[offsets] = edge[offsets] = True  # a document ends where the next one begins
        self.starts = np.flatnonzero(~gap & before[:-1])
        self.ends = np.flatnonzero(~gap & edge[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False, second: bool = False) -> np.ndarray:
        """64 bits of each word; ``second`` ones don't depend on the first."""
        codes = mix(byte_codes(lower) ^ U64(0x2545F4914F6CDD1D)) if second else byte_codes(lower)
        return rolling(0x8CB92BA72F3D8DD7 if second else 0xD6E8FEB86659FD93).runs(codes[self.data], self.starts, self.ends)

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        offsets = np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)), offsets - low


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes, with their bytes and offsets."""
    data, offsets = buffers(column)
    n, low = len(offsets) - 1, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def windows(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of ``length`` words that lies in one document, and its document."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    total = int(counts.sum())
    document = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - begin[document] + first[:-1][document], document
