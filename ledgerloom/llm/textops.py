"""Words, lines and shingles of whole texts, vectorised over Arrow buffers inside tasks.

A batch is cut into pieces of bounded bytes between rows, so memory follows the piece and the longest
single text, never the batch. Words are maximal runs of bytes other than space and 0x09-0x0D, after
A-Z is folded to a-z. A null text is an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
ROWS_AT_ONCE = 500
U64 = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15
_RADIX = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hasher:
    """Polynomial hashes of byte ranges, wherever they lie. One per task: it keeps its tables."""

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(MULTIPLIER))
        self.up = self.down = np.ones(1, dtype=U64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE_BYTES + 1)
            up, down = np.full(n, _RADIX, dtype=U64), np.full(n, pow(_RADIX, -1, 1 << 64), dtype=U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(U64))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes of its text column and the rows' offsets into them."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        start, rows = 0, part.num_rows
        texts = pc.fill_null(part.column(column), "").cast(pa.large_string())
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        while start < rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(rows, max(end, start + 1))
            own = offsets[start : end + 1]
            yield part.slice(start, end - start), data[own[0] : own[-1]], own - own[0]
            start = end
        del texts, buffers, data
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its memory
        pass


@dataclass
class Words:
    """Words of a piece in order: byte ranges, row of each, 64-bit hash of each."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # index of each row's first word; one more entry at the end


def words(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Words:
    folded = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(starts, offsets, side="left")
    return Words(starts, ends, row, hasher.ranges(folded, starts, ends), first)


def shingles(w: Words, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each row; a shorter row is one shingle, an empty row none."""
    h = w.hashes
    n = len(h)
    rolled = np.zeros(max(0, n - size + 1), dtype=U64) + U64(size)
    for j in range(size):
        rolled = mix(rolled * U64(MULTIPLIER) + h[j : n - size + 1 + j]) if len(rolled) else rolled
    for r in range(len(w.first) - 1):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= size:
            yield r, np.unique(rolled[a : b - size + 1])
        elif b > a:
            state = np.array([b - a], dtype=U64)
            for j in range(a, b):
                state = mix(state * U64(MULTIPLIER) + h[j : j + 1])
            yield r, state
        else:
            yield r, np.zeros(0, dtype=U64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
