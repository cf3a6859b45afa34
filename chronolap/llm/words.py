"""Vectorised words and hashes of whole Arrow batches of text.

A word is a run of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; this equals the pattern
[^\\x20\\x09-\\x0D]+ on the text, as UTF-8 keeps those bytes to themselves. Hashes are 64 bits of a
polynomial over randomly mapped bytes with the length mixed in; equal words give equal hashes, and
different words collide with a chance of about 2**-64 for each pair.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 19
_POWERS = {}
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("n", 0)
    if n > have:
        n = max(n, _BLOCK + 4096)
        for k, base in (("p", _BASE), ("i", _INVERSE)):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
        _POWERS["n"] = n
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string()).cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], dtype=np.int64, count=len(a) + 1, offset=8 * a.offset)
    data = a.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(low: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run of bytes b with word[b]), and the place of each row's first word (one more than rows)."""
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = word[low]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of low[start:end] for ordered spans that do not overlap; memory stays in blocks."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _BLOCK, side="right")))
        b = int(ends[j - 1])
        power, inverse = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


class Words:
    """Word hashes of a batch of texts: hash h[first[k]:first[k+1]] belongs to row k."""

    __slots__ = ("low", "offsets", "starts", "ends", "first", "h")

    def __init__(self, column: pa.Array):
        raw, self.offsets = buffers(column)
        self.low = LOWER[raw]
        self.starts, self.ends, self.first = spans(self.low, self.offsets)
        self.h = hashes(self.low, self.starts, self.ends)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order, repeats kept; with fewer words the whole sequence as one."""
    if not len(h):
        return h
    n = min(k, len(h))
    m = len(h) - n + 1
    s = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        s = mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + m])
    return s


def release() -> None:
    """Give memory that is free back to the system; workers that go from task to task would keep it."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the text of each stays near the limit in bytes (a row is never cut)."""
    for b in batches:
        if not b.num_rows:
            continue
        if b.nbytes > limit:
            release()
        _, off = buffers(b.column(b.schema.get_field_index(column)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j
    release()
