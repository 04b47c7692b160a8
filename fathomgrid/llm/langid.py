"""Language identification: words first, then shorter and shorter character n-grams.

A word is a run of letters and of the marks on them, lower-cased by Unicode; of scripts
that don't part words, each ideograph and kana is a word.  A known word scores its log frequency in
each language.  An unseen one falls back to its n-grams of ``ORDERS[0]`` characters
(with marks at both ends of the word) that are known, and where none is, to the next
shorter order.  A text sums the scores of its words; the posterior of the best
language, tempered by length, is the score.

The model is fitted on at most about ``FIT_ROWS`` labelled rows of a language,
chosen by a hash of doc_id, and keeps the most frequent ``WORDS`` words and ``GRAMS``
n-grams of an order and language (fewer with many languages), so its size is fixed.
Every text is predicted whole.  Null texts, and texts without a letter, are ``und``
with score 0; so is everything if no labelled row exists.  Rows are independent.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.llm import textkernel as tk

FIT_ROWS, WORDS, GRAMS, ORDERS = 5000, 50_000, 50_000, (4, 3, 2, 1)
#: Code points that are words of their own: kana and ideographs.
SINGLE = ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x323B0))


@lru_cache(1)
def kinds() -> np.ndarray:
    """For each code point 1 for a letter, 2 for one that is a word of its own, 3 for a mark, else 0."""
    of = {"L": 1, "M": 3}
    out = np.array([of.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)
    for lo, hi in SINGLE:
        out[lo:hi][out[lo:hi] == 1] = 2
    return out


def joined(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all ranges, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Vocabulary:
    """Distinct words of a batch, with n-grams on demand; ``doc`` and ``count``: text of each word, words of each text."""

    def __init__(self, col: pa.Array) -> None:
        texts = [(t or "").lower() for t in col.to_pylist()]
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        kind = kinds()[self.chars.astype(np.int64)]
        run = (kind == 1) | (kind == 3)
        edge = np.zeros(len(kind) + 1, bool)
        edge[off] = True
        before, after = np.append(False, run[:-1])[: len(run)], np.append(run[1:], False)[: len(run)]
        start = np.flatnonzero((run & (~before | edge[:-1])) | (kind == 2))
        end = np.flatnonzero((run & (~after | edge[1:])) | (kind == 2)) + 1
        self.count = np.diff(np.searchsorted(start, off))
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        letter = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2))))
        self.lettered = letter[off[1:]] > letter[off[:-1]]
        hashes = tk.ranged(tk.prefix(tk.mix(self.chars)), start, end)
        self.hash, at, self.back = np.unique(hashes, return_index=True, return_inverse=True)
        self.start, self.size = start[at], (end - start)[at]

    def grams(self, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index into which) of the n-grams of words, with a mark at both ends; words too short have none."""
        size = self.size[which]
        first = np.cumsum(size + 2) - (size + 2)
        chars = np.zeros(int((size + 2).sum()), np.uint64)
        chars[joined(first + 1, size)] = self.chars[joined(self.start[which], size)]
        chars[first], chars[first + size + 1] = 2, 3
        if len(chars) < order:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(which)), size + 2)
        key = tk.grams(tk.mix(chars), order) + tk.U(order)
        inside = owner[: len(key)] == owner[order - 1 :]
        return key[inside], owner[: len(key)][inside]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (lang, text) to (lang, kind, h, c); kind 0 are words, others the order of n-grams."""
    for b in tk.slices(batches):
        langs = b.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            v = Vocabulary(b.column("text").filter(pa.array([x == lang for x in langs])))
            times = np.bincount(v.back, minlength=len(v.hash))
            sets = [(0, v.hash, times)]
            for order in ORDERS:
                key, of = v.grams(np.arange(len(v.hash)), order)
                key, back = np.unique(key, return_inverse=True)
                sets.append((order, key, np.bincount(back, weights=times[of], minlength=len(key)).astype(np.int64)))
            for kind, key, c in sets:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(np.full(len(key), kind, np.int32)), tk.signed(key), pa.array(c.astype(np.int64))], names=["lang", "kind", "h", "c"])


class Model:
    """Log frequencies of the kept words and n-grams, by language."""

    def __init__(self, rows: list[tuple[str, int, int, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.langs)}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind in (0, *ORDERS):
            own = [r for r in rows if r[1] == kind]
            keys, back = np.unique(np.array([r[2] for r in own], np.int64).view(np.uint64), return_inverse=True)
            count = np.zeros((len(keys), len(self.langs)))
            np.add.at(count, (back, [number[r[0]] for r in own]), [r[3] for r in own])
            smooth = count + 0.5
            self.tables[kind] = (keys, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))

    def find(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, row) of each hash."""
        keys = self.tables[kind][0]
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, at

    def scores(self, v: Vocabulary) -> np.ndarray:
        """A row of log frequencies for each distinct word; words unknown at every order score 0."""
        out = np.zeros((len(v.hash), len(self.langs)), np.float32)
        known, at = self.find(0, v.hash)
        out[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(left):
                break
            key, of = v.grams(left, order)
            known, at = self.find(order, key)
            of, at = of[known], at[known]
            times = np.bincount(of, minlength=len(left))
            for j in range(len(self.langs)):
                total = np.bincount(of, weights=self.tables[order][1][at, j], minlength=len(left))
                out[left, j] = np.where(times > 0, total / np.maximum(times, 1), out[left, j])
            left = left[times == 0]
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(col)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        v = Vocabulary(col)
        words, doc = self.scores(v), v.doc
        relative = words - words.max(axis=1, keepdims=True) if len(words) else words
        relative = np.maximum(relative, -6.0)  # no word alone outweighs several others
        total = np.stack([np.bincount(doc, weights=relative[v.back, j], minlength=n) for j in range(len(self.langs))], axis=1)
        tempered = total / np.sqrt(np.maximum(v.count, 1))[:, None]
        odds = np.exp(tempered - tempered.max(axis=1, keepdims=True))
        share = odds / odds.sum(axis=1, keepdims=True)
        best = np.argmax(total, axis=1)
        return [self.langs[j] if ok else "und" for j, ok in zip(best, v.lettered, strict=True)], np.where(v.lettered, share[np.arange(n), best], 0.0)


def fold(column: Column) -> Column:
    """crc32 of an id as text; that of the empty text for null."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame, rows: int = FIT_ROWS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """The model of labelled ``docs`` (doc_id, text, lang)."""
    docs = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model([])
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, rows / n)).otherwise(share)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    counts = picked.select("lang", "text").mapInArrow(counted, "lang string, kind int, h long, c long").groupBy("lang", "kind", "h").agg(F.sum("c").alias("c"))
    most = lambda n: max(1000, min(n, 8 * n // len(sizes)))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("c"), "h"))
    top = counts.withColumn("r", place).filter(F.col("r") <= F.when(F.col("kind") == 0, most(words)).otherwise(most(grams))).select("lang", "kind", "h", "c")
    return Model([tuple(r) for r in top.toPandas().itertuples(index=False)])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches):
            lang, score = model.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
