"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Outputs of the model are the ``HEAD`` most frequent training words, the end token,
and one class for every other word by a fixed hash of its last letters; a word of a
class has its share of the class by training counts.  The score of output w after
the tokens u, v is  x1 * Q1[v].R[w] + x2 * Q2[u].R[w] + b[w],  with vectors of
``WIDTH`` numbers, so all scores of a context pair come from two matrix products, and
so does the normaliser of every pair: token probabilities add up to one.

All training documents are counted: words, and pairs of outputs at distances one
and two (two matrices of (HEAD + CLASSES + 1)**2 counts whatever the input).
Noise-contrastive estimation fits R, Q1, Q2 and b to these counts in numpy, with the
unigram distribution as noise and all noise terms in expectation.  The two weights x
are chosen by exact likelihood over all training tokens, which the counts determine.

Counts of the most frequent words, at most ``KNOWN`` and cut where counts differ by a
sixteenth of a power of two, travel with the tasks; the others' come from a join on
the word's hash.  Null texts are empty: just the end token.  Rows are
scored one by one, equal rows get equal scores.  Without training documents all words
are unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import textkernel as tk
from fathomgrid.llm.base import keyed, settled, stored

HEAD, CLASSES, WIDTH, KNOWN, NOISE, ROUNDS = 767, 256, 40, 200_000, 20, 150
SIZE = HEAD + CLASSES + 1  # output 0 is the end, then the head words, then the classes
LN10 = float(np.log(10))


def ends_of(w: tk.Words) -> np.ndarray:
    """Class of each word by its last three bytes."""
    value = np.zeros(len(w.start), np.uint64)
    for back in range(1, 4):
        at = w.end - back
        value = value * tk.U(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)].astype(np.uint64) + tk.U(1), tk.U(0))
    return (tk.mix(value) % tk.U(CLASSES)).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: training texts to (h, class, c) for each batch."""
    for b in tk.slices(batches):
        w = tk.Words(b.column("text"), lower=True)
        h, at, c = np.unique(w.hash, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([tk.signed(h), pa.array(ends_of(w)[at].astype(np.int32)), pa.array(c.astype(np.int64))], names=["h", "cls", "c"])


@dataclass
class Lexicon:
    """Sorted hashes of the known words with their counts and output numbers (0: of a class)."""

    hash: np.ndarray
    count: np.ndarray
    output: np.ndarray

    def outputs(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """(output, place in the lexicon or -1) of each word."""
        if not len(self.hash):
            return HEAD + 1 + ends_of(w), np.full(len(w.hash), -1)
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        known = self.hash[at] == w.hash
        head = np.where(known, self.output[at], 0)
        return np.where(head > 0, head, HEAD + 1 + ends_of(w)), np.where(known, at, -1)


def sequences(out: np.ndarray, w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, u, v, w): the outputs of all tokens with the two before each, ends included; a text starts after two ends."""
    n = w.count + 1
    doc = np.repeat(np.arange(len(n)), n)
    last = np.cumsum(n) - 1
    token = np.zeros(len(doc), np.int64)
    inner = np.ones(len(doc), bool)
    inner[last] = False
    token[inner] = out
    first = last - n + 1
    v = np.concatenate(([0], token[:-1]))
    u = np.concatenate(([0, 0], token[:-2]))[: len(token)]
    v[first] = 0
    u[first] = 0
    u[np.minimum(first + 1, len(u) - 1)] = 0
    return doc, u, v, token


def paired(lexicon: Lexicon):  # noqa: ANN201
    """A mapInArrow function: texts to (kind, row, counts), the rows of two count matrices, once for a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for b in tk.slices(batches):
            w = tk.Words(b.column("text"), lower=True)
            _, u, v, t = sequences(lexicon.outputs(w)[0], w)
            for kind, before in enumerate((v, u)):
                key, c = np.unique(before * SIZE + t, return_counts=True)
                total[kind, key] += c
        table = total.reshape(2 * SIZE, SIZE)
        rows = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array([table[i].astype("<i8").tobytes() for i in rows], pa.binary())], names=["row", "counts"])

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows dealt by their number: adds up the counts of each."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for row, counts in zip(b.column("row").to_pylist(), b.column("counts").to_pylist(), strict=True):
            total[row] = total.get(row, 0) + np.frombuffer(counts, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["row", "counts"])


def trained(near: np.ndarray, far: np.ndarray, width: int = WIDTH, noise: int = NOISE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Scores (Q1.R, Q2.R + b) from the two count matrices, by full-batch NCE and Adam."""
    size = len(near)
    rng = np.random.Generator(np.random.PCG64(5))
    unigram = near.sum(axis=0) + 0.5
    unigram = unigram / unigram.sum()
    base = np.log(noise * unigram).astype(np.float32)
    data = []
    for counts in (near, far):
        total = max(counts.sum(), 1)
        data.append(((counts / total).astype(np.float32), (counts.sum(axis=1, keepdims=True) / total).astype(np.float32) * (noise * unigram).astype(np.float32)))
    params = [rng.normal(0, 0.1, (size, width)).astype(np.float32) for _ in range(3)] + [np.log(unigram).astype(np.float32)]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        grads = [np.zeros_like(p) for p in params]
        for k, (true, false) in enumerate(data):
            # Objective: sum of true * log(sigma) + false * log(1 - sigma), sigma of the score less the noise's.
            score = params[1 + k] @ params[0].T + params[3] - base
            sigma = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            g = true * (1 - sigma) - false * sigma
            grads[0] += g.T @ params[1 + k]
            grads[1 + k] = g @ params[0]
            grads[3] += g.sum(axis=0)
        rate = 0.1 * min(1.0, 2 * (1 - t / (rounds + 1)))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-9)
    r, q1, q2, b = params
    return q1 @ r.T, np.concatenate((q2 @ r.T, b[None]), axis=0)


@dataclass
class Model:
    """Tables of natural-log scores; log P(w | u, v) = a[v, w] + c[u, w] - z[u, v]."""

    a: np.ndarray
    c: np.ndarray
    z: np.ndarray

    @classmethod
    def of(cls, near: np.ndarray, far: np.ndarray, bias: np.ndarray, x1: float, x2: float) -> Model:
        a, c = x1 * near, x2 * far + bias
        top, bottom = a.max(axis=1, keepdims=True), c.max(axis=1, keepdims=True)
        z = np.log(np.exp(c - bottom) @ np.exp(a - top).T) + bottom + top.T
        return cls(a.astype(np.float32), c.astype(np.float32), z.astype(np.float32))

    def log_probability(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.a[v, w].astype(np.float64) + self.c[u, w] - self.z[u, v]


def tuned(near: np.ndarray, far: np.ndarray, after: np.ndarray, second: np.ndarray) -> Model:
    """The weights of the two positions with the best likelihood over all tokens.

    ``after`` and ``second`` count the pairs at distances one and two.  The token after
    a pair u, v has the two as its context, if v is not the end; the other contexts
    are those of first tokens, two ends each.
    """
    bias, far = far[-1], far[:-1]
    contexts = after.copy()
    contexts[:, 0] = 0
    contexts[0, 0] = after[0].sum()
    one, two, own = (after * near).sum(), (second * far).sum(), after.sum(axis=0) @ bias
    best: tuple[float, Model] | None = None
    for x1, x2 in ((1.0, 0.0), (0.9, 0.2), (0.8, 0.4), (0.7, 0.5), (0.6, 0.6), (0.5, 0.7), (0.9, 0.4), (0.8, 0.6)):
        model = Model.of(near, far, bias, x1, x2)
        value = float(x1 * one + x2 * two + own - (contexts * model.z).sum())
        if best is None or value > best[0]:
            best = (value, model)
    return best[1]


def scorer(lexicon: Lexicon, model: Model, within: np.ndarray):  # noqa: ANN201
    """A mapInArrow function: keyed documents to sums of log10 terms and the words whose counts are elsewhere.

    ``within``: by class the log10 of the denominator of a word's share.
    """
    log_count = np.log10(lexicon.count + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches):
            n = b.num_rows
            w = tk.Words(b.column("text"), lower=True)
            out, at = lexicon.outputs(w)
            doc, u, v, t = sequences(out, w)
            lm = np.bincount(doc, weights=model.log_probability(u, v, t) / LN10, minlength=n)
            tail, known = out > HEAD, at >= 0
            value = np.where(known, log_count[np.maximum(at, 0)], 0.0) if len(log_count) else np.zeros(len(out))
            lm += np.bincount(w.doc, weights=np.where(tail, value - within[np.maximum(out - HEAD - 1, 0)], 0.0), minlength=n)
            words = np.bincount(w.doc, weights=value, minlength=n)
            seen = np.bincount(w.doc[known], minlength=n)
            rest_doc, rest = w.doc[~known], w.hash[~known]
            order = np.lexsort((rest, rest_doc))
            rest_doc, rest = rest_doc[order], rest[order]
            new = np.concatenate(([True], (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1]))) if len(rest) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(rest)))
            off = np.concatenate(([0], np.cumsum(np.bincount(rest_doc[start], minlength=n)))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([tk.signed(rest[start]), pa.array(times.astype(np.int32))], names=["h", "tf"])
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), b.column("doc_id"), pa.array(w.count.astype(np.int64) + 1), pa.array(seen.astype(np.int64)), pa.array(words), pa.array(lm), pa.ListArray.from_arrays(pa.array(off), pairs)],
                names=["k1", "k2", "doc_id", "n_tokens", "seen", "words", "lm", "rest"],
            )

    return run


def frequent(counts: DataFrame) -> DataFrame:
    """The words of the highest counts, at most KNOWN, found by a histogram of some hundred classes of counts."""
    level = F.floor(F.log2("c") * 16).cast("int")
    taken, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        taken += r.n
        if taken > KNOWN:
            break
        least = r.level
    return counts.filter(level >= least if least is not None else F.lit(False))


def scored(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; learns from ``training``."""
    counts = stored(training.select("text").mapInArrow(counted, "h long, cls int, c long").groupBy("h").agg(F.first("cls").alias("cls"), F.sum("c").alias("c")))
    ends = training.count()
    top = frequent(counts).toPandas().sort_values(["c", "h"], ascending=[False, True]).reset_index(drop=True)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(total) + ends, int(distinct) + (ends > 0)
    output = np.zeros(len(top), np.int64)
    output[: min(HEAD, len(top))] = np.arange(1, min(HEAD, len(top)) + 1)
    order = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))
    lexicon = Lexicon(top["h"].to_numpy(np.int64).view(np.uint64)[order], top["c"].to_numpy(np.int64)[order], output[order])
    of_head = top[:HEAD].groupby("cls").agg(c=("c", "sum"), v=("c", "size"))
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for cls, c, k in counts.groupBy("cls").agg(F.sum("c"), F.count("*")).collect():  # at most CLASSES rows
        mass[cls], types[cls] = c, k
    for cls, r in of_head.iterrows():
        mass[cls] -= r["c"]
        types[cls] -= r["v"]
    within = np.log10(mass + 0.5 * (types + 1))

    rows = training.select("text").mapInArrow(paired(lexicon), "row int, counts binary").repartition("row").mapInArrow(summed, "row int, counts binary")
    table = np.zeros((2 * SIZE, SIZE))
    for row, c in rows.toLocalIterator():  # 2 * SIZE rows
        table[row] = np.frombuffer(bytes(c), "<i8")
    near, far = trained(table[:SIZE], table[SIZE:])
    model = tuned(near, far, table[:SIZE], table[SIZE:])

    parts = stored(keyed(docs).mapInArrow(scorer(lexicon, model, within), "k1 long, k2 int, doc_id long, n_tokens long, seen long, words double, lm double, rest array<struct<h:long,tf:int>>"))
    rest = parts.select("k1", "k2", F.explode("rest").alias("r")).select("k1", "k2", "r.h", "r.tf").distinct()
    looked = rest.join(counts.select("h", "c"), "h", "left").groupBy("k1", "k2").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("also"))
    out = parts.drop("rest").join(settled(looked), ["k1", "k2"], "left")
    end = float(np.log10(ends + 0.5))
    words = F.col("words") + F.coalesce("more", F.lit(0.0))
    base = words + end - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    known = F.col("seen") + F.coalesce("also", F.lit(0)) + (1 if ends else 0)
    return out.select("doc_id", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lm") + F.coalesce("more", F.lit(0.0))).alias("score"))
