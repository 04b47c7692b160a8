"""Fuzzy matching of file names: subsequence filter in the JVM, alignment score in numpy.

The score rewards matches at word boundaries, camel humps, runs and the file name, and
charges gaps.  The first character of a path counts as a boundary.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the score.  Fixed values.
MATCH, BOUNDARY, CAMEL, CONSECUTIVE, GAP_START, GAP_EXTENSION, FILENAME = 16, 8, 7, 8, -3, -1, 4
SEPARATORS = b"/_-. \\"
LOWEST = -(2**30)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def has_subsequence(haystack: Column, needle: str) -> Column:
    """Whether all characters of the needle stand in order, ASCII case ignored."""
    low = "".join(c.lower() if c.isascii() else c for c in needle)
    return ascii_lower(haystack).rlike("(?s)" + ".*?".join(re.escape(c) for c in low))


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of bytes, a row for each text, zeros behind its end; and the lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return out, size


def spans(low: np.ndarray, needle: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, start, end) of each row: where its earliest match ends, and the latest start for that end."""
    rows, width = low.shape
    at = np.arange(width)
    found, end = np.ones(rows, bool), np.zeros(rows, np.int64)
    for c in needle:
        ahead = (low == c) & (at >= end[:, None])
        found &= ahead.any(axis=1)
        end = ahead.argmax(axis=1) + 1 if width else end
    start = end.copy()
    for c in reversed(needle):
        behind = (low == c) & (at < start[:, None])
        start = width - 1 - behind[:, ::-1].argmax(axis=1) if width else start
    return found, np.where(found, start, 0), np.where(found, end, 0)


def scores(paths: list[str], needle: str, full: bool) -> np.ndarray:
    """Alignment scores of the needle with paths (``full``) or their file names; LOWEST where it is no subsequence.

    With B the bonus of a position, S(i, h) scores the first i characters of the needle
    within the first h positions of the span:  S(i, h) = max(hit, skip),  hit = S(i-1, h-1) + B(h)
    and more if i-1 was hit at h-1,  skip = S(i, h-1) less the price of a gap that starts or goes on.
    A column h needs only the column before it, so all i and all paths are done at once.
    """
    wanted = np.frombuffer(needle.encode().lower(), np.uint8)
    whole = [p.encode() for p in paths]
    names = [p.rfind(b"/") + 1 for p in whole]
    raw, size = padded(whole if full else [p[n:] for p, n in zip(whole, names, strict=True)])
    if not len(paths) or not len(wanted):
        return np.full(len(paths), LOWEST)
    upper = (raw >= 65) & (raw <= 90)
    low = raw + upper * np.uint8(32)
    found, start, end = spans(low, wanted.tobytes())
    before = np.pad(raw, ((0, 0), (1, 0)))[:, :-1]
    edge = np.isin(before, np.frombuffer(SEPARATORS, np.uint8))
    edge[:, :1] = True
    camel = ~edge & upper & (before >= 97) & (before <= 122)
    in_name = np.arange(raw.shape[1]) >= (np.array(names)[:, None] if full else 0)
    bonus = MATCH + BOUNDARY * edge + CAMEL * camel + FILENAME * in_name

    best = np.full(len(paths), LOWEST)
    state = np.full((len(paths), len(wanted) + 1), LOWEST)
    state[:, 0] = 0
    met = np.zeros(state.shape, bool)  # the last position was a hit
    gap = np.zeros((len(paths), len(wanted)), bool)
    row = np.arange(len(paths))
    for h in range(int((end - start).max(initial=0))):
        at = np.minimum(start + h, raw.shape[1] - 1)
        same = (low[row, at][:, None] == wanted) & (start + h < end)[:, None]
        hit = np.where(same, state[:, :-1] + bonus[row, at][:, None] + CONSECUTIVE * met[:, :-1], LOWEST)
        skip = state[:, 1:] + np.where(gap, GAP_EXTENSION, GAP_START)
        gap = hit < skip
        state[:, 1:] = np.maximum(hit, skip)
        met[:, 1:] = same & ~gap & (hit > LOWEST // 2)
        best = np.maximum(best, state[:, -1])
    return np.where(found, best - size // 16, LOWEST)


def score(path: str, needle: str, full: bool) -> int | None:
    """The score of one path; None if the needle is no subsequence."""
    value = int(scores([path], needle, full)[0])
    return value if value > LOWEST // 2 else None


def ranked(paths: DataFrame, query: str, k: int, path: str = "path") -> DataFrame:
    """The k best (path, score); full paths only if the query has a slash.  An empty query finds nothing."""
    if not query:
        return paths.sparkSession.createDataFrame([], "path string, score int")
    full = "/" in query
    where = F.col(path) if full else F.substring_index(path, "/", -1)
    few = paths.select(F.col(path).alias("path")).filter(has_subsequence(where, query))

    @F.pandas_udf("int")
    def scored(s: pd.Series) -> pd.Series:
        return pd.Series(scores(s.tolist(), query, full), dtype="int32")

    return few.withColumn("score", scored("path")).orderBy(F.desc("score"), "path").limit(k)
