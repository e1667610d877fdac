"""Vectorised words, word hashes and k-grams over Arrow string columns.

All functions work on UTF-8 bytes with numpy, a piece of a record batch at a time, so the memory of a
task is bounded by PIECE_BYTES (or by its longest single text) and no Python object is made per word.
Separators are ASCII, and an ASCII byte never occurs inside a multi-byte character, so cutting bytes
is cutting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text is cut at separators inside `Words`.
PIECE_BYTES = 1 << 19

#: Bytes of words `[^\x20\x09-\x0D]+`.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (digits, a-z and everything beyond ASCII).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_LOW_BITS = 12


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(0xD6E8FEB86659FD93, 1 << _LOW_BITS)
_POW_HIGH = _powers(pow(0xD6E8FEB86659FD93, 1 << _LOW_BITS, 1 << 64), 1 << 16)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about PIECE_BYTES of text (columns `texts`, of the name `text` by default) each, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = sum(utf8(batch.column(name))[1] for name in texts or ("text",))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE_BYTES, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


class Words:
    """The words of a string column.

    starts, ends: byte places in `data`; hashes: one 64-bit hash a word; at: words before each row
    (one more than rows), so that row r has the words at[r]..at[r+1]-1.
    """

    def __init__(self, column: pa.Array, members: np.ndarray = PLAIN, lower: bool = False, hashed: bool = True):
        self.data, self.offsets = utf8(column)
        if lower:
            self.data = LOWER[self.data]
        parts = list(self._cut(members, hashed))
        self.starts, self.ends = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
        if hashed:
            self.hashes = np.concatenate([p[2] for p in parts] or [np.zeros(0, np.uint64)])
        self.at = np.searchsorted(self.starts, self.offsets, "left")
        self.at[-1:] = len(self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    def _cut(self, members: np.ndarray, hashed: bool) -> Iterator[tuple[np.ndarray, ...]]:
        size, low = len(self.data), 0
        while low < size:
            high = min(size, low + 4 * PIECE_BYTES)
            while high < size:  # move on to a separator or the end of a row
                look = self.data[high : high + 65536]
                stop = np.flatnonzero(~members[look])
                row_end = self.offsets[np.searchsorted(self.offsets, high)]
                step = int(stop[0]) if len(stop) else len(look)
                if row_end <= high + step:
                    high = int(row_end)
                    break
                high += step
                if len(stop):
                    break
            yield self._piece(low, high, members, hashed)
            low = high

    def _piece(self, low: int, high: int, members: np.ndarray, hashed: bool) -> tuple[np.ndarray, ...]:
        data = self.data[low:high]
        inside = members[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        rows = self.offsets[np.searchsorted(self.offsets, low) : np.searchsorted(self.offsets, high, "right")] - low
        edge[rows] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not hashed:
            return starts + low, ends + low
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64)
        at = np.flatnonzero(inside)
        length = ends - starts
        begin = np.cumsum(length) - length
        place = np.arange(len(at)) - np.repeat(begin, length)
        value = _BYTE[data[at]] * _POW[place & ((1 << _LOW_BITS) - 1)]
        if length.max() > 1 << _LOW_BITS:
            value *= _POW_HIGH[(place >> _LOW_BITS) & 0xFFFF]
        hashes = mix(np.add.reduceat(value, begin) ^ (length.astype(np.uint64) << np.uint64(48)))
        return starts + low, ends + low, hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its row, itself included."""
        return np.repeat(self.at[1:], self.counts) - np.arange(len(self))

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def kgrams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each place on; the last k-1 places are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xA0761D6478BD642F + 0x5851F42D4C957F2E * salt) & 0xFFFFFFFFFFFFFFFF | 1)
    source = mix(hashes, salt) if salt else hashes
    out = source[:n].copy()
    for j in range(1, k):  # Horner: the first word has the highest power
        out *= base
        out += source[j : j + n]
    return mix(out, salt)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(at: np.ndarray, values: pa.Array) -> pa.Array:
    """List column from offsets and flat values."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
