"""Long byte repeats by a run-length index.

Candidate segments come from ``repeats``.  A shard's segments, each ended by a sentinel of its own, are sorted by suffix once; what is kept
of it is the Burrows-Wheeler transform as runs of equal letters, with the text positions
sampled at both ends of each run.  The common prefix of a suffix with its neighbour
above has to be measured at heads of runs only, and with its neighbour below at their
tails: where two neighbouring rows carry the same letter, the value for the text
position before is one more.  The neighbour of a head is the tail before it, so the
samples are all that is needed, and the matching statistics stream along the text from
sample to sample.  Segments of equal content are sorted once, with their number: in the
transform the rows of copies stand side by side under equal letters, so they make runs
longer and add none, and each has its like as a neighbour.

Null texts are empty.  Texts shorter than a window are left as they are.  Matches
never cross documents.  Equal rows count as one document with one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import textkernel as tk
from fathomgrid.llm.base import keyed
from fathomgrid.llm.repeats import Unit, bounds, covered, repeated_windows

WINDOW, GRAM = 400, 64
#: A byte that UTF-8 never has.
END = 0xFF


class RunIndex:
    """The run-compressed transform of texts, with the samples that matching statistics need."""

    def __init__(self, texts: list[bytes], times: list[int] | None = None) -> None:
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.text = np.frombuffer(b"".join(t + bytes([END]) for t in texts), np.uint8)
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        self.left = (self.first[1:][self.owner] - 1 - np.arange(len(self.text))).astype(np.int32)  # bytes before the sentinel
        self.times = np.ones(len(texts), np.int64) if times is None else np.array(times, np.int64)
        order = self._suffixes()
        before = self.text[order - 1].astype(np.int16)
        before[self.left[order - 1] == 0] = -1  # the letter before a text's start is its own end
        head = np.ones(len(before), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads = np.flatnonzero(head)
        self.letters, self.lengths = before[heads], np.add.reduceat(self.times[self.owner[order]], heads)
        self.head_samples, self.tail_samples = order[heads], order[np.append(heads[1:], len(order)) - 1]

    def _suffixes(self) -> np.ndarray:
        """Suffix order by prefix doubling from eight bytes; ties end at the sentinels, which sort by text."""
        n = len(self.text)
        wide = np.concatenate((self.text, np.zeros(8, np.uint8))).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(8):
            letter = np.where(self.left >= j, wide[j : j + n], 0).astype(np.uint64)
            key = (key << tk.U(8)) | letter
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        start = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        h, active = 8, np.arange(n)
        while True:
            begin = start[active]
            single = begin & np.append(begin[1:], True)
            active = active[~single]
            if not len(active):
                return order
            p = order[active]
            inside = self.left[p] >= h
            second = np.where(inside, rank[np.minimum(p + h, n - 1)] + len(self.first), self.owner[p])
            sort = np.argsort(rank[p].astype(np.uint64) << tk.U(32) | second.astype(np.uint64))
            p, first, second = p[sort], rank[p][sort], second[sort]
            order[active] = p
            new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
            start[active] = new
            rank[p] = np.maximum.accumulate(np.where(new, active, 0))
            h *= 2

    def _common(self, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Bytes that the suffixes at a and b share before either ends; 0 where these are fewer than ``least``."""
        sums = tk.prefix(tk.BYTE[self.text])
        back = tk.powers(len(sums), tk.INV)
        most = np.minimum(self.left[a], self.left[b])

        def same(a: np.ndarray, b: np.ndarray, to: np.ndarray | int) -> np.ndarray:
            return (sums[a + to] - sums[a]) * back[a] == (sums[b + to] - sums[b]) * back[b]

        out = np.zeros(len(a), np.int64)
        some = np.flatnonzero(most >= least)
        some = some[same(a[some], b[some], least)]
        a, b, most = a[some], b[some], most[some]
        low = np.full(len(some), least, np.int64)
        step = 1 << int((most - low).max(initial=1)).bit_length()
        while step and len(some):
            to = np.minimum(low + step, most)
            low = np.where(same(a, b, to), to, low)
            step >>= 1
        out[some] = low
        return out

    def _streamed(self, samples: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values at the samples, carried on along the text: each place has one less than the place before, or its own."""
        n = len(self.text)
        known = np.zeros(n, bool)
        known[samples] = True
        out = np.zeros(n, np.int64)
        out[samples] = values
        last = np.maximum.accumulate(np.where(known, np.arange(n), 0))
        return np.maximum(out[last] - (np.arange(n) - last), 0)

    def matching_statistics(self, least: int = 0) -> np.ndarray:
        """For each place the longest string from there that also starts at another place; less or 0 where it is below ``least``."""
        between = self._common(self.head_samples[1:], self.tail_samples[:-1], least)
        above = self._streamed(self.head_samples, np.append(0, between))
        below = self._streamed(self.tail_samples, np.append(between, 0))
        return np.where(self.times[self.owner] > 1, self.left, np.minimum(np.maximum(above, below), self.left))


def run_index(window: int):  # noqa: ANN201
    """An engine for ``repeats.sharded``."""

    def run(rows: list[dict]) -> Iterator[tuple[int, int, list[int]]]:
        index = RunIndex([r["content"] for r in rows], [r["n"] for r in rows])
        long = index.matching_statistics(window) >= window
        for r, at in zip(rows, index.first.tolist(), strict=False):
            if (own := long[at : at + r["len"]]).any():
                runs = bounds(own)
                yield r["s"], 0, runs
                if r["n"] > 1:
                    yield r["s"], 1, runs

    return run


def digests(window: int):  # noqa: ANN201
    """A mapInArrow function: (doc_id, text, spans) to the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches):
            data, off = tk.flat(b.column("text"))
            cols: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, spans in enumerate(b.column("spans").to_pylist()):
                own = data[off[i] : off[i + 1]]
                gone = covered(len(own), spans, window) if spans else None
                left = (own if gone is None else own[~gone]).tobytes()
                for k, v in zip(cols, (len(own), len(own) - len(left), 0 if gone is None else len(bounds(gone)) // 2, hashlib.sha256(left).hexdigest(), left), strict=True):
                    cols[k].append(v)
            types = {"kept_sha256": pa.string(), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, types.get(k, pa.int64())) for k, v in cols.items())], names=["doc_id", *cols])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): bytes of windows that start twice or more are removed."""
    docs = keyed(docs)
    spans = repeated_windows(docs, Unit(False, window, gram), run_index(window), **limits)
    joined = docs.join(spans.hint("merge"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(digests(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select("doc_id", *(F.col(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")))
