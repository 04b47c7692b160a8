"""Quality rules as weak supervision.

Each rule votes good (1), bad (0) or abstains (-1).  The votes of all documents are
counted by pattern, at most 3**len(RULES) rows whatever the input, and expectation
maximisation on these counts estimates how often each rule is right about good and
about bad documents.  A document is kept when its posterior probability of being
good is at least ``threshold``; one bad vote among good ones does not drop it.

Null texts have no words.  Every row is answered on its own, so repeated rows and
null or repeated ids need no care; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import textkernel as tk
from fathomgrid.llm.base import settled

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_lines", "n_stops"]
WINDOW = 8


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, text) to doc_id and MEASURES."""
    for b in tk.slices(batches):
        w = tk.Words(b.column("text"))
        n, data, off = b.num_rows, w.data, w.off
        total = lambda flags, at=off: np.diff(np.concatenate(([0], np.cumsum(flags)))[at])
        head = (data & 0xC0) != 0x80  # one for each code point
        cols = {"n_words": w.count, "word_chars": total(head & ~tk.SPACE[data]), "n_symbols": total(SYMBOL[data])}

        # Lines: a line that holds a word and equals an earlier one of its text.
        newline = data == 10
        start = np.unique(np.concatenate((off[:-1], np.flatnonzero(newline) + 1)))
        start = start[start < len(data)]
        if len(start):
            edge = np.append(start[1:], len(data))
            end = np.where(newline[edge - 1], edge - 1, edge)
            sums = tk.prefix(tk.BYTE[data])
            doc = np.searchsorted(off, start, side="right") - 1
            worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
            line = tk.ranged(sums, start, end) ^ tk.mix(doc.astype(np.uint64))
            first = np.zeros(len(line), bool)
            first[np.unique(line, return_index=True)[1]] = True
            cols["n_dup_lines"] = np.bincount(doc[worded & ~first], minlength=n)
            cols["n_lines"] = np.bincount(doc[worded], minlength=n)
        else:
            cols["n_dup_lines"] = cols["n_lines"] = np.zeros(n, np.int64)

        # Words in windows that recur in their text.
        covered = np.zeros(len(w.doc) + 1, np.int64)
        if len(w.doc) >= WINDOW:
            key = tk.grams(w.hash, WINDOW)
            inside = w.doc[: len(key)] == w.doc[WINDOW - 1 :]
            at = np.flatnonzero(inside)
            _, back, times = np.unique(key[at] ^ tk.mix(w.doc[at].astype(np.uint64)), return_inverse=True, return_counts=True)
            again = at[times[back] > 1]
            np.add.at(covered, again, 1)
            np.add.at(covered, again + WINDOW, -1)
        repeat = np.cumsum(covered)[:-1] > 0
        cols["n_repeat_words"] = np.bincount(w.doc[repeat], minlength=n)

        pair = np.unique(w.hash ^ tk.mix(w.doc.astype(np.uint64)), return_index=True)[1]
        cols["n_distinct"] = np.bincount(w.doc[pair], minlength=n)
        upper = (data >= 65) & (data <= 90)
        cols["n_upper"], cols["n_letters"] = total(upper), total(upper | ((data >= 97) & (data <= 122)) | (data >= 0xC3))
        cols["n_stops"] = np.bincount(w.doc[(w.end - w.start) <= 3], minlength=n)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(cols[m].astype(np.int64)) for m in MEASURES)], names=["doc_id", *MEASURES])


def rules() -> dict[str, Column]:
    """The labelling functions: 1 good, 0 bad, -1 abstain."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(c("n_words") == 0, -1).when(bad, 0).when(good, 1).otherwise(-1)

    share = lambda part, whole="n_words": c(part) / F.greatest(c(whole), F.lit(1))
    return {
        "length": vote(c("n_words") < 20, c("n_words") >= 50),
        "repeats": vote(share("n_repeat_words") > 0.3, share("n_repeat_words") < 0.1),
        "symbols": vote(share("n_symbols") > 0.1, share("n_symbols") < 0.02),
        "symbol_chars": vote(share("n_symbols", "word_chars") > 0.03, share("n_symbols", "word_chars") < 0.003),
        "lines": vote(share("n_dup_lines", "n_lines") > 0.3, share("n_dup_lines", "n_lines") < 0.1),
        "variety": vote((share("n_distinct") < 0.25) & (c("n_words") < 2000), share("n_distinct") > 0.35),
        "case": vote(share("n_upper", "n_letters") > 0.4, share("n_upper", "n_letters") < 0.15),
        "word_length": vote((c("word_chars") / words < 2.5) | (c("word_chars") / words > 12), (c("word_chars") / words).between(3, 9)),
        "short_words": vote((c("n_words") >= 20) & (share("n_stops") < 0.02), share("n_stops") > 0.1),
    }


#: First belief about a rule: P(good vote | bad document) and P(good vote | good document).
#: A rule sees one kind of fault, so bad documents pass most rules and good ones nearly all.
BELIEF = (0.65, 0.985)


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.75) -> tuple[float, np.ndarray]:
    """Expectation maximisation: the share of good documents, and P(vote 1 | class, not abstaining) as (rules, 2).

    Starts from BELIEF and smooths by it, so that it also settles on few documents
    and on unanimous ones, and so that the two classes can't change places.
    """
    m = votes.shape[1]
    right = np.tile(BELIEF, (m, 1)).astype(float)
    total = max(counts.sum(), 1.0)
    weight = 0.01 * total + 1
    for _ in range(rounds):
        p = posterior(votes, prior, right)
        w1, w0 = counts * p, counts * (1 - p)
        prior = float(np.clip((w1.sum() + 0.75) / (total + 1), 0.05, 0.99))
        for j in range(m):
            yes, no = votes[:, j] == 1, votes[:, j] == 0
            right[j, 1] = (w1[yes].sum() + BELIEF[1] * weight) / (w1[yes | no].sum() + weight)
            right[j, 0] = (w0[yes].sum() + BELIEF[0] * weight) / (w0[yes | no].sum() + weight)
        right[:, 0] = np.minimum(right[:, 0], right[:, 1] - 0.05)
        right = np.clip(right, 0.01, 0.999)
    return prior, right


def posterior(votes: np.ndarray, prior: float, right: np.ndarray) -> np.ndarray:
    """P(good) of each row of votes."""
    log1, log0 = np.log(prior), np.log(1 - prior)
    for j in range(votes.shape[1]):
        v = votes[:, j]
        log1 = log1 + np.where(v == 1, np.log(right[j, 1]), np.where(v == 0, np.log(1 - right[j, 1]), 0))
        log0 = log0 + np.where(v == 1, np.log(right[j, 0]), np.where(v == 0, np.log(1 - right[j, 0]), 0))
    return 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, MEASURES, the votes, ``p_good``, ``base_failed`` and ``kept`` of every row of ``docs``."""
    votes = rules()
    measures = docs.select("doc_id", "text").mapInArrow(measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    measures = settled(measures.withColumns({f"vote_{k}": v.cast("int") for k, v in votes.items()}))
    names = [f"vote_{k}" for k in votes]
    seen = measures.groupBy(*names).count().collect()  # at most 3**len(votes) rows
    pattern = np.array([r[:-1] for r in seen], np.int64).reshape(-1, len(names))
    prior, right = fit(pattern, np.array([r[-1] for r in seen], float))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for j, k in enumerate(names):
        yes, no = np.log(right[j, 1] / right[j, 0]), np.log((1 - right[j, 1]) / (1 - right[j, 0]))
        odds = odds + F.when(F.col(k) == 1, float(yes)).when(F.col(k) == 0, float(no)).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = measures.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
