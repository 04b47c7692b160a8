"""Vectorised kernels over Arrow batches of text: words, hashes, windows.

A word is a run of bytes other than space and \\x09-\\x0D of the UTF-8 text, the
same as the pattern ``[^\\x20\\x09-\\x0D]+`` over characters.  All hashes are 64 bits
wide and depend on content only, so that they agree between executors and reruns.
Texts are handled in slices of about ``CHUNK`` bytes, whole texts each, which
bounds the memory of a worker whatever the batch size.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1_000_000
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15 | 1)
INV = U(pow(int(STEP), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TOP = U(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets of the texts; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1 + col.offset)[col.offset :] if off else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data and len(off) else np.zeros(0, np.uint8)
    return data, off - off[0]


def released() -> None:
    """Gives freed memory back to the system: workers stay, and share a machine with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = flat(batch.column(batch.schema.get_field_index(text)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    released()


class Words:
    """Words of a batch: ``start``/``end`` bytes, ``doc``, ``hash``; ``first``: of doc i, the words first[i]:first[i+1]."""

    def __init__(self, col: pa.Array | tuple[np.ndarray, np.ndarray], lower: bool = False, hashes: bool = True, space: np.ndarray = SPACE) -> None:
        data, off = col if isinstance(col, tuple) else flat(col)
        self.data = data = LOWER[data] if lower else data
        self.off, n = off, len(off) - 1
        word = ~space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before = np.concatenate(([False], word[:-1])) if len(word) else word
        after = np.concatenate((word[1:], [False])) if len(word) else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        if hashes:
            self.hash = np.zeros(0, np.uint64)
            if len(self.start):
                gap = np.diff(np.append(self.start, len(data)))
                at = np.arange(self.start[0], len(data)) - np.repeat(self.start, gap)
                value = BYTE[data[self.start[0] :]] * powers(int(at.max()) + 1)[at]
                value[~word[self.start[0] :]] = 0
                self.hash = mix(np.add.reduceat(value, self.start - self.start[0]) + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``ranged``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def ranged(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of values by content, length included."""
    back = powers(len(sums), INV)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * U(0x632BE59BD9B4E019))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    start = np.arange(n)
    return ranged(prefix(values), start, start + k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values: block minima from both sides."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    y = np.concatenate((x, np.full(pad, TOP, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(valid: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds [a, b) of maximal runs of valid places with equal keys."""
    n = len(valid)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    same = valid[1:] & valid[:-1]
    for k in keys:
        same &= k[1:] == k[:-1]
    new[1:] = ~same
    at = np.flatnonzero(new)
    to = np.append(at[1:], n)
    use = valid[at]
    return at[use], to[use]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
