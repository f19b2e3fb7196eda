"""Vectorised word hashing over Arrow string columns, for use inside Spark tasks.

A word is a maximal run of bytes other than space and the control characters 9-13. All of these are
ASCII, so the work is done on UTF-8 bytes without decoding. Every hash is 64-bit and the same in every
task, so hashes made in different tasks can be joined.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of a task, whatever the batch holds.
CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Odd multipliers for hashing sequences of words.
MULTIPLIERS = _RNG.integers(1, 1 << 63, 512, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Returns memory that a finished task no longer uses to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """Words of some documents: their hashes, byte ranges and, for document i, the range first[i]:first[i+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def text(self, i: int) -> str:
        return bytes(self.data[self.starts[i] : self.ends[i]]).decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type):
        column, large = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut into runs of rows of about size bytes of text (one longer text is a run of its own)."""
    for batch in batches:
        data, offsets = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, cut: np.ndarray | None = None) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]; a new one begins at the bytes in cut as well."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    starts = inside[1:] & ~inside[:-1]  # of length n + 1
    ends = inside[:-1] & ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    if cut is not None:
        edge = np.concatenate([edge, cut])
    both = edge[inside[edge] & inside[edge + 1]]  # a word ends and another starts where two texts meet
    starts[both] = ends[both] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _power(_BASE, n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words: entry i covers words i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k <= 4:
        total = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * MULTIPLIERS[j]
        return mix(total)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=total[1:])
    return mix((total[k:] - total[:n]) * _power(_INVERSE, n) + np.uint64(k))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))
