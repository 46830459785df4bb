"""Whole Arrow batches of texts as one byte buffer: words, hashes and n-grams without a Python step per word.

A chunk is a run of documents joined by newlines, about CHUNK bytes of them (a longer document is a chunk of its
own), so that temporaries stay small whatever the batch holds.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
_trim: list = []
with contextlib.suppress(OSError, AttributeError):
    # arrays of a chunk's size get pages of their own, which go back to the system when they are freed
    ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 18)
    _trim.append(ctypes.CDLL("libc.so.6").malloc_trim)


def release() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    for f in _trim:
        f(0)


def released(run: Callable) -> Callable:
    """run, a function for mapInArrow or for groups in Arrow, with `release` once it has ended: a Python worker waits for its
    next task, and what it keeps meanwhile is taken from those at work."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    def group(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, tables)
        release()

    return group if run.__code__.co_argcount == 2 else over


def _table(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


#: Bytes inside words: all but ASCII white space, `[^\x20\x09-\x0D]`.
SPACED = _table(b" \t\n\x0b\x0c\r")
#: Bytes inside words: ASCII digits, lower-case letters and everything beyond ASCII, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`.
ALNUM = _table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_seeded = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _seeded.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for exponents below n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        for k, x in enumerate((_BASE, _INVERSE)):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that makes their order look random."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def order(x: np.ndarray) -> np.ndarray:
    """Stable order of unsigned 64-bit values. Their upper bits are sorted together with their places, as plain numbers,
    which is much faster; where that is not enough to tell hashes apart, which is rare, the whole values are sorted."""
    low = U((1 << max(len(x) - 1, 1).bit_length()) - 1)
    out = (np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)
    y = x[out]
    return np.argsort(x, kind="stable") if (y[1:] < y[:-1]).any() else out


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums of buf, one longer than it; see span_hash."""
    up, _ = _power(len(buf) + 1)
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    v = _BYTE[buf]
    v *= up[: len(buf)]
    np.cumsum(v, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal bytes have equal values, wherever they stand and in whichever chunk."""
    _, down = _power(len(sums))
    x = sums[end] - sums[start]
    x *= down[start]
    x += (end - start).astype(np.uint64)
    return mix(x)


@dataclass
class Chunk:
    rows: range  # of the batch
    buf: np.ndarray
    start: np.ndarray  # of each document in buf
    end: np.ndarray

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word in buf and, longer by one than the documents, where each one's words begin."""
        m = inside[self.buf]
        cut = np.flatnonzero(m[1:] != m[:-1]) + 1
        if len(m) and m[0]:
            cut = np.concatenate(([0], cut))
        if len(m) and m[-1]:
            cut = np.concatenate((cut, [len(m)]))
        ws, we = cut[0::2], cut[1::2]
        return ws, we, np.searchsorted(ws, np.append(self.start, len(self.buf) + 1))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return pc.fill_null(column, b"").to_pylist()


def chunks(column: pa.Array | list, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    texts = column if isinstance(column, list) else as_bytes(column)
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        lens = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lens + 1) - 1
        joined = b"\n".join(part)
        buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        yield Chunk(range(at, end), buf, ends - lens, ends)
        at = end


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a document, and the index of each run's first word."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = h[: n - k + 1].copy()
    for j in range(1, k):
        g *= U(_STEP)
        g += h[j : n - k + 1 + j]
    ok = np.ones(n - k + 1, bool)
    for j in range(1, k):  # runs that would pass a document's end
        b = first[1:-1] - j
        b = b[(b >= 0) & (b < len(ok))]
        ok[b] = False
    at = np.flatnonzero(ok)
    return mix(g[at]), at


def sliding(x: np.ndarray, w: int, f: np.ufunc = np.minimum) -> np.ndarray:
    """f over every run of w values; len(x) - w + 1 of them."""
    out, have = x, 1
    while have * 2 <= w:
        out = f(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = f(out[: len(out) - (w - have)], out[w - have :])
    return out


def union_length(start: np.ndarray, end: np.ndarray) -> int:
    """Positions covered by spans that are sorted by start."""
    if not len(start):
        return 0
    reach = np.maximum.accumulate(end)
    before = np.concatenate(([start[0]], reach[:-1]))
    return int(np.maximum(reach - np.maximum(before, start), 0).sum())
