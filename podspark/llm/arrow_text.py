"""Text columns of Arrow batches as one byte array with offsets, so that numpy can work on many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Byte values of the ASCII white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets into them; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``max_bytes`` of text; a longer text is alone in its run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max_bytes, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte value, the same in every process."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class SpanHash:
    """Hash of any stretch of a sequence of 64-bit codes in constant time.

    Prefix sums of code * base^i modulo 2^64; dividing a difference of sums by base^start makes
    the hash of a stretch the same wherever it stands.
    """

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.power(_BASE, n), out=self.sums[1:])
        self.back = self.power(_INVERSE, n + 1)

    @classmethod
    def power(cls, base: int, n: int) -> np.ndarray:
        have = cls._powers.get(base)
        if have is None or len(have) < n:
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            have = cls._powers[base] = np.cumprod(steps)
        return have[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every text, and per text the first word's index (n + 1)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    first[edges] = solid[edges]
    start = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[at[1:][at[:-1] < at[1:]] - 1] = solid[at[1:][at[:-1] < at[1:]] - 1]
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and per text the first word's index (n + 1)."""
    start, end, index = word_bounds(data, at)
    if not len(start):
        return np.empty(0, np.uint64), index
    return SpanHash(byte_codes(seed)[data]).of(start, end), index
