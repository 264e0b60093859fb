"""Flat views of Arrow text columns: word spans, word hashes, bounded slices.

Everything here works on one Arrow batch inside a task. Arrays are sized by the
slice being worked on (``SLICE_BYTES`` of text, or one longer text), never by
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

# Fixed byte classes.
SPACE = b" \t\n\x0b\x0c\r"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACE)] = False
#: digits, a-z and every byte above ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array, and where each text starts (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray):
    """Start and end of each maximal run of ``kind`` bytes inside a text, and each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(begin, offs)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    total = int(length.sum())
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(start - (np.cumsum(length) - length), length)
    return out


class WordHash:
    """64-bit hashes of byte spans: random values per byte times powers of an odd base, then mixed."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 1 << 64, 256, dtype=np.uint64)
        self.base = rng.integers(1, 1 << 63, 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros(0, np.uint64)
        length = end - begin
        if (top := int(length.max())) > len(self.powers):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.repeat(self.base, 2 * top)]), dtype=np.uint64)
        first = np.cumsum(length) - length
        value = self.table[data[spread(begin, length)]]
        value *= self.powers[spread(np.zeros_like(first), length)]
        return mix(np.add.reduceat(value, first))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp value of every run of n word hashes: a polynomial in an odd base, modulo 2**64."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= base
        out += h[j: len(h) - n + 1 + j]
    return out
