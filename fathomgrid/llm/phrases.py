"""Repeated phrases by sharded Aho-Corasick automata.

Candidate segments come from ``repeats``, each content once, with its number.  In a shard
the phrases that recur are confirmed by their hashes.  Half windows become
numbers, written in a few digits of a private alphabet with letters of their own for each
digit, so that a phrase of 20 words is a short string and no node of the automaton has
many branches.  A segment is read as ten such strings, one from each of its first ten
words.  The phrases are compiled into an automaton, and all
segments of the shard are streamed through it to locate every occurrence.  The first
place of each phrase (document, then position) stays, later ones are marked.

Null texts have no words.  Texts of fewer words than a window are left as they are.
Equal rows count as one document; a null doc_id comes before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomgrid.llm import textkernel as tk
from fathomgrid.llm.base import keyed
from fathomgrid.llm.repeats import Unit, bounds, covered, repeated_windows

WINDOW, GRAM = 20, 5


#: Letters of a digit.
BASE = 64


def run_of(window: int) -> int:
    """Words of a run: the largest part of a window that fits twice."""
    return max(d for d in range(1, max(1, window // 2) + 1) if window % d == 0)


def written(ids: np.ndarray, digits: int) -> str:
    """Numbers in ``digits`` characters each; every digit has an alphabet of its own, so that no number is read from its middle."""
    parts = [ids // BASE**j % BASE + BASE * j for j in range(digits)]
    return np.stack(parts, axis=-1).astype("<u4").tobytes().decode("utf-32-le")


def automaton(window: int):  # noqa: ANN201
    """An engine for ``repeats.sharded``."""
    step = run_of(window)
    parts = window // step

    def run(rows: list[dict]) -> Iterator[tuple[int, int, list[int]]]:
        w = tk.Words(pa.array([r["content"] for r in rows], pa.binary()).cast(pa.string()))
        n = len(w.hash) - window + 1
        key = tk.grams(w.hash, window)
        at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
        _, one, back, times = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
        copies = np.array([r["n"] for r in rows])[w.doc[at]] > 1
        again = times > 1
        again[back[copies]] = True
        if not again.any():
            return
        # Runs of words that some recurring phrase has are numbers from 1 on; all others are 0.
        used = np.zeros(len(w.hash) - step + 1, bool)
        for j in range(0, window, step):
            used[at[again[back]] + j] = True
        sign = np.zeros(len(used), np.int64)
        sign[used] = np.unique(tk.grams(w.hash, step)[used], return_inverse=True)[1] + 1
        digits = 1
        while BASE**digits <= sign.max():
            digits += 1
        long = parts * digits
        phrases = written(sign[at[one[again]][:, None] + np.arange(0, window, step)].ravel(), digits)
        machine = ahocorasick.Automaton()
        for i in range(int(again.sum())):
            machine.add_word(phrases[i * long : (i + 1) * long], i)
        machine.make_automaton()

        # The segments in the order of their places, each as ``step`` strings, ended by 0.
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i]["k1"], rows[i]["k2"], rows[i]["a"])))
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        place = np.flatnonzero(w.doc[: len(sign)] == w.doc[step - 1 :])
        string = rank[w.doc[place]] * step + (place - w.first[w.doc[place]]) % step
        place = place[np.lexsort((place, string))]
        string = np.sort(string)
        slot = np.arange(len(place)) + np.cumsum(np.diff(string, prepend=string[:1]) > 0)
        stream = np.zeros(int(slot[-1]) + 1, np.int64)
        stream[slot] = sign[place]
        of_slot = np.zeros(len(stream), np.int64)
        of_slot[slot] = place
        ends, phrase = (np.array(x, np.int64) for x in zip(*machine.iter(written(stream, digits)), strict=True))
        start = of_slot[ends // digits - parts + 1]
        turn = rank[w.doc[start]] * (len(w.hash) + 1) + start
        first = np.full(int(again.sum()), np.iinfo(np.int64).max)
        np.minimum.at(first, phrase, turn)
        found, later = np.zeros(len(w.hash), bool), np.zeros(len(w.hash), bool)
        found[start] = True
        later[start] = turn != first[phrase]
        for r, lo in zip(rows, w.first.tolist(), strict=False):
            if (own := later[lo : lo + r["len"]]).any():
                yield r["s"], 0, bounds(own)
            if r["n"] > 1 and (own := found[lo : lo + r["len"]]).any():  # the other places of the same content come after this one
                yield r["s"], 1, bounds(own)

    return run


def digests(window: int):  # noqa: ANN201
    """A mapInArrow function: (doc_id, text, spans) to the kept words and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches):
            w = tk.Words(b.column("text"), hashes=False)
            count, removed, kept = w.count, [], []
            for i, spans in enumerate(b.column("spans").to_pylist()):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                gone = covered(hi - lo, spans, window)
                removed.append(int(gone.sum()))
                words = w.data[w.off[i] : w.off[i + 1]].tobytes().split()
                kept.append(b" ".join(x for x, g in zip(words, gone.tolist(), strict=True) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each word covered by a window that starts earlier too is removed."""
    docs = keyed(docs)
    spans = repeated_windows(docs, Unit(True, window, gram), automaton(window), **limits)
    joined = docs.join(spans.hint("merge"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(digests(window), "doc_id long, n_words long, n_removed long, kept_text string")
