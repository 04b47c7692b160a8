"""Benchmark decontamination by SimHash over item-sized windows.

An item of L words is held against windows of L words of every document, as
multisets of k-word shingles.  Windows that share too few shingles with all items taken
together can't be similar to one and are passed over; every other one that begins at a
shared shingle gets a SimHash of ``BITS`` bits.  (Windows of one size are the more similar
the more they share, so one that begins there is the best of a document and item.)

The fingerprints alone choose the candidates.  They are indexed in PARTS blocks of 16
bits: within ``RADIUS`` bits of each other, two fingerprints differ in at most 3 bits of
some block, by the pigeonhole principle.  An item stands in the index under all values at
most 1 bit away, and a window looks up all values at most 2 bits away from its own, so
every item within the radius is found.  (At similarity 0.8 the distance is 39 bits, with
a deviation of 6: beyond 63 bits lie about 9 windows in a million, and fewer the more
similar they are; unrelated texts never come that near.)  Candidates are verified by
exact weighted Jaccard similarity.

Items come in blocks of about ``BLOCK``, each held against all documents; the texts of a
block travel with the tasks.  Words
are lower-cased A-Z.  An item of fewer than k words is one shingle; a document
shorter than an item is one window.  An item_id may be null or recur.  Null or empty items and texts match nothing.
Repeated rows each give their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import textkernel as tk

BITS, PARTS, RADIUS, BLOCK = 256, 16, 63, 20_000
#: Values of a block at most one and two bits away.
ONE = np.array([0, *(1 << i for i in range(16))])
TWO = np.array([*ONE, *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))]).astype("<u2")
#: Windows that are looked up together, and words that they span at most, but for their own size.
GROUP, SPAN = 512, 4096


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of BITS numbers, 1 or -1, for each shingle."""
    wide = tk.mix(shingles[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * tk.STEP)
    return np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as PARTS blocks of 16 bits, from rows of sums of signs."""
    return np.packbits(sums >= 0, axis=1).view("<u2")


class Items:
    """Benchmark items with their shingles and the multi-index of their fingerprints."""

    def __init__(self, ids: list[int | None], texts: list[str], k: int, similarity: float) -> None:
        w = tk.Words(pa.array(texts, pa.string()), lower=True)
        self.k, self.similarity, self.ids, self.size = k, similarity, ids, w.count.tolist()
        self.width = [min(k, n) for n in self.size]
        self.shingles = [tk.grams(w.hash[w.first[i] : w.first[i] + n], self.width[i]) if n else np.zeros(0, np.uint64) for i, n in enumerate(self.size)]
        self.print = np.concatenate([np.zeros((0, PARTS), "<u2"), *(packed(signs(s).sum(axis=0)[None]) for s in self.shingles)])
        some = np.flatnonzero(w.count > 0)
        near = self.print[some][:, None, :] ^ ONE[:, None].astype("<u2")
        self.index = []
        for p in range(PARTS):
            value, item = near[:, :, p].ravel(), np.repeat(some, len(ONE))
            order = np.argsort(value, kind="stable")
            times = np.bincount(value, minlength=1 << 16)
            self.index.append((times > 0, np.concatenate(([0], np.cumsum(times))), item[order]))
        self.by_width = {}
        for width in sorted({x for x in self.width if x}):
            of = [i for i, x in enumerate(self.width) if x == width]
            keys = np.unique(np.concatenate([self.shingles[i] for i in of]))
            flags = np.zeros(1 << 20, bool)
            flags[(keys & tk.U((1 << 20) - 1)).astype(np.int64)] = True
            self.by_width[width] = (keys, flags, sorted({self.size[i] for i in of}))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all items within RADIUS bits of each row of ``prints``."""
        rows, items = [], []
        for p, (used, off, item) in enumerate(self.index):
            at = (prints[:, p, None] ^ TWO).ravel()
            some = np.flatnonzero(used[at])
            at = at[some].astype(np.int64)
            lo, times = off[at], off[at + 1] - off[at]
            rows.append(np.repeat(some // len(TWO), times))
            items.append(item[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())])
        pair = np.unique(np.concatenate(rows) * len(self.ids) + np.concatenate(items))
        row, item = np.divmod(pair, max(len(self.ids), 1))
        near = np.bitwise_count(prints[row] ^ self.print[item]).sum(axis=1) <= RADIUS
        return row[near], item[near]

    def alike(self, i: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of item i and a window's shingles."""
        a, m = np.unique(self.shingles[i], return_counts=True)
        b, n = np.unique(window, return_counts=True)
        common, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        both = int(np.minimum(m[x], n[y]).sum()) if len(common) else 0
        return both / (len(self.shingles[i]) + len(window) - both)

    def matches(self, col: pa.Array) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, first word, similarity) of the best window of each similar pair."""
        w = tk.Words(col, lower=True)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for width, (keys, flags, sizes) in self.by_width.items():
            grams = tk.grams(w.hash, width)
            if not len(grams):
                continue
            inside = w.doc[: len(grams)] == w.doc[width - 1 :]
            at = np.flatnonzero(inside & flags[(grams & tk.U((1 << 20) - 1)).astype(np.int64)])
            at = at[keys[np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)] == grams[at]]
            cut = np.flatnonzero(np.diff(w.doc[at], prepend=-1))
            for x, y in zip(cut, np.append(cut, len(at))[1:], strict=True):
                self._text(w, grams, width, sizes, at[x:y], best)
        for (d, i), (score, start) in best.items():
            yield d, i, start, score

    def _text(self, w: tk.Words, grams: np.ndarray, width: int, sizes: list[int], hits: np.ndarray, best: dict) -> None:
        """Looks up the windows of one text that hold enough of ``hits``, the places of shingles that some item has."""
        d = int(w.doc[hits[0]])
        first, last = int(w.first[d]), int(w.first[d + 1])
        windows = []
        for size in sizes:
            own = min(size, last - first)
            start = np.unique(np.minimum(hits, last - own))
            held = np.searchsorted(hits, start + own - width, "right") - np.searchsorted(hits, start, "left")
            start = start[held >= self.similarity / (1 + self.similarity) * (own + size - 2 * width + 2) - 1e-9]
            windows.append(np.stack((start, np.full(len(start), own)), axis=1))
        rows = np.unique(np.concatenate(windows), axis=0)
        at = 0
        while at < len(rows):
            to = min(at + GROUP, int(np.searchsorted(rows[:, 0], rows[at, 0] + SPAN)))
            start, own = rows[at:to, 0], rows[at:to, 1]
            low = int(start[0])
            sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(signs(grams[low : int((start + own).max()) - width + 1]), axis=0)))
            row, item = self.candidates(packed(sums[start - low + own - width + 1] - sums[start - low]))
            for r, j in zip(row.tolist(), item.tolist(), strict=True):
                s, n = int(start[r]), int(own[r])
                if min(self.size[j], last - first) == n and self.width[j] == width:
                    score = self.alike(j, grams[s : s + n - width + 1])
                    old = best.get((d, j), (0.0, 0))
                    if score >= self.similarity and (score > old[0] or (score == old[0] and s - first < old[1])):
                        best[d, j] = (score, s - first)
            at = to


def search(ids: list[int | None], texts: list[str], k: int, similarity: float):  # noqa: ANN201
    """A mapInArrow function: (doc_id, text) to (doc_id, item_id, start, similarity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, k, similarity)
        for b in tk.slices(batches):
            found = list(items.matches(b.column("text")))
            if found:
                doc, item, start, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(start, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "item_id", "start", "similarity"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, start, similarity): pairs of a document and an item that it has a similar window of."""
    bench = benchmark.select("item_id", "text").filter("text is not null")
    schema = "doc_id long, item_id long, start long, similarity double"
    blocks = -(-bench.count() // block)
    parts = []
    for i in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect()  # about ``block`` rows
        if rows:
            find = search([r.item_id for r in rows], [r.text for r in rows], k, similarity)
            parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, parts)
