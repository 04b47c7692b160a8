"""Finding long repeats: which windows of a fixed length recur anywhere in a corpus.

Two operators share this plan; they differ in the unit (words or bytes) and in the
index that decides within a shard.

1.  Every window takes as its anchor the least hash of the short grams in it.  Equal
    windows have equal anchors, wherever they stand.  A maximal run of windows of
    one document with one anchor is a segment: (anchor, place, hash of its content).
    A segment has at most as many windows as a window has grams: of longer runs, as in
    periodic text, the pieces are segments.
2.  Anchors seen once are dropped; their windows cannot recur, unless the anchor's
    gram itself recurs in the segment, which the segment's ``own`` tells.
3.  Segments of equal content are one, with a count, a first and a last place.
4.  Their texts are cut out once, with whether they occur several times, and dealt by
    anchor into shards of bounded size, each under an index of its own.  The index alone
    finds the windows that recur, within segments and between them.
5.  Its findings go back to the places by content, the first place and all others apart,
    and the spans of a document are merged when its text is read the last time.

An anchor whose distinct segments have more than ``wide`` bytes is too much for one
shard.  Its windows become segments of their own, each with its content as its anchor;
each that recurs goes to the index like all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import textkernel as tk
from fathomgrid.llm.base import settled, stored

#: About how many bytes a shard has, and how many of one anchor it takes: an index needs some 60 bytes of memory for each.
MOST, WIDE = 1_000_000, 6_000_000
PLACES = ["k1", "k2", "a", "len", "g", "s", "own"]
PLACE = "k1 long, k2 int, a int, len int, g long, s long, own boolean"
PLACE_OF = "k1:bigint,k2:int,a:int"
#: Low bits of an anchor's hash that give way to its position, more values than a window has grams.
LOW = tk.U(1023)


@dataclass(frozen=True)
class Unit:
    """Bytes or words: how long windows and grams are, and where the values of a text come from."""

    words: bool
    window: int
    gram: int

    @property
    def width(self) -> int:
        """Grams in a window."""
        return self.window - self.gram + 1

    def values(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, tk.Words | None]:
        """Hashable values of all texts, and the n + 1 places where texts start."""
        if self.words:
            w = tk.Words(col)
            return w.hash, w.first, w
        data, off = tk.flat(col)
        return tk.BYTE[data], off, None


def segments(unit: Unit):  # noqa: ANN201
    """A mapInArrow function: keyed documents to the places of their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches):
            values, first, _ = unit.values(b.column("text"))
            n = len(values) - unit.window + 1
            if n <= 0:
                continue
            sums = tk.prefix(values)
            at = np.arange(len(values) - unit.gram + 1)
            hashes, width = tk.ranged(sums, at, at + unit.gram) | LOW, unit.width
            place = at.astype(np.uint64) & LOW
            one = tk.sliding_min(hashes ^ place ^ LOW, width) ^ LOW
            two = tk.sliding_min(hashes ^ place, width)
            least = one | LOW
            tie = (one ^ two) & LOW != 0  # a window with its least gram at two places may equal one of the same run
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            lo, hi = tk.runs(doc[:n] == doc[unit.window - 1 :], least)
            if not len(lo):
                continue
            pieces = -(-(hi - lo) // width)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo, end = np.repeat(lo, pieces) + nth * width, np.repeat(hi, pieces)
            hi = np.minimum(lo + width, end)
            ties = np.concatenate(([0], np.cumsum(tie)))
            own = ties[hi] > ties[lo]
            of = doc[lo]
            content = tk.ranged(sums, lo, hi - 1 + unit.window)
            pick = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [b.column("k1").take(pick), b.column("k2").take(pick), pa.array((lo - first[of]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), tk.signed(least[lo]), tk.signed(content), pa.array(own)],
                names=PLACES,
            )

    return run


def windows_of(unit: Unit):  # noqa: ANN201
    """A mapInArrow function: documents with ``cuts`` to the single windows of each cut, hashed by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches):
            values, first, _ = unit.values(b.column("text"))
            sums = tk.prefix(values)
            for i, cuts in enumerate(b.column("cuts").to_pylist()):
                for c in cuts:
                    off = np.arange(c["len"])
                    at = first[i] + c["a"] + off
                    h = tk.signed(tk.ranged(sums, at, at + unit.window))
                    same = [pa.array(np.full(len(off), c[k], np.int64)) for k in ("s", "n")]
                    here = pa.StructArray.from_arrays([pa.array(np.full(len(off), b.column("k1")[i].as_py(), np.int64)), pa.array(np.full(len(off), b.column("k2")[i].as_py(), np.int32)), pa.array((c["a"] + off).astype(np.int32))], names=["k1", "k2", "a"])
                    yield pa.RecordBatch.from_arrays([*same, pa.array(off.astype(np.int32)), h, here], names=["s", "n", "off", "h", "first"])

    return run


def cut_out(unit: Unit):  # noqa: ANN201
    """A mapInArrow function: documents with ``cuts`` to the content of each cut; words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches):
            _, first, w = unit.values(b.column("text"))
            data, off = tk.flat(b.column("text"))
            rows: dict[str, list] = {k: [] for k in ("g", "s", "n", "k1", "k2", "a", "len", "content")}
            for i, cuts in enumerate(b.column("cuts").to_pylist()):
                k1, k2, base = b.column("k1")[i].as_py(), b.column("k2")[i].as_py(), int(first[i])
                for c in cuts:
                    lo, hi = base + c["a"], base + c["a"] + c["len"] - 1 + unit.window
                    piece = data[w.start[lo] : w.end[hi - 1]].tobytes() if w else data[lo:hi].tobytes()
                    for k, v in (("g", c["g"]), ("s", c["s"]), ("n", c["n"]), ("k1", k1), ("k2", k2), ("a", c["a"]), ("len", c["len"]), ("content", piece)):
                        rows[k].append(v)
            types = {"g": pa.int64(), "s": pa.int64(), "n": pa.int64(), "k1": pa.int64(), "k2": pa.int32(), "a": pa.int32(), "len": pa.int32(), "content": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in rows.items()], names=list(rows))

    return run


#: Finds the recurring windows of some segments: (segment's content, 0 for its first place or 1 for all others, bounds of its runs).
Engine = Callable[[list[dict]], Iterator[tuple[int, int, list[int]]]]


def sharded(engine: Engine, most: int):  # noqa: ANN201
    """A mapInArrow function over rows sorted by anchor: whole anchors of about ``most`` bytes go to ``engine`` together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = list(engine(rows))
            span = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
            covers = [[{"lo": lo, "hi": hi} for lo, hi in zip(c[::2], c[1::2], strict=True)] for *_, c in found]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array(covers, pa.list_(span))], names=["s", "copy", "cover"])

        for b in batches:
            for r in b.to_pylist():
                if size >= most and r["g"] != rows[-1]["g"]:
                    yield flush()
                    rows, size = [], 0
                rows.append(r)
                size += len(r["content"])
        if rows:
            yield flush()
            rows = []
        tk.released()

    return run


def bounds(flags: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.tolist()


def merged(offsets: Column) -> Column:
    """[lo, hi) of the runs of consecutive numbers in an array."""
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    one = lambda lo, hi: F.array(F.struct(lo.alias("lo"), hi.alias("hi")))

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), one(last["lo"], x + 1))
        return F.when(last["hi"] == x, longer).otherwise(F.concat(acc, one(x, x + 1)))

    return F.aggregate(F.array_sort(offsets), none, add)


def repeated_windows(docs: DataFrame, unit: Unit, engine: Engine, most: int = MOST, wide: int = WIDE) -> DataFrame:
    """(k1, k2, spans) of keyed documents: spans [lo, hi) of starts of windows to remove, ``array<struct<lo,hi>>``.

    What is removed at the first place of a content and at its other places is up to ``engine``.
    """
    places = stored(docs.mapInArrow(segments(unit), PLACE))
    multi = stored(places.groupBy("g").agg(F.count("*").alias("n"), F.bool_or("own").alias("own")).filter("n > 1 or own").select("g"))
    hits = stored(places.join(multi, "g", "left_semi").select("k1", "k2", "a", "len", "g", "s"))
    place = F.struct("k1", "k2", "a")
    found = stored(hits.groupBy("s").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("g").alias("g"), F.first("len").alias("len")))

    def cuts(of: DataFrame) -> DataFrame:
        """Documents with the cuts that ``of`` has first in them."""
        each = of.groupBy("first.k1", "first.k2").agg(F.collect_list(F.struct("first.a", "len", "g", "s", "n")).alias("cuts"))
        return docs.join(each.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "cuts")

    def covers(contents: DataFrame) -> DataFrame:
        """(s, cover, rest) of contents in which windows recur: those to remove at the first place, and at the others."""
        texts = cuts(contents).mapInArrow(cut_out(unit), "g long, s long, n long, k1 long, k2 int, a int, len int, content binary")
        shards = texts.repartition("g").sortWithinPartitions("g")
        out = stored(shards.mapInArrow(sharded(engine, most), "s long, copy int, cover array<struct<lo:int,hi:int>>"))
        of = lambda copy: F.first(F.when(F.col("copy") == copy, F.col("cover")), ignorenulls=True)
        return out.groupBy("s").agg(of(0).alias("cover"), of(1).alias("rest"))

    size = (F.col("len") + unit.window) * (8 if unit.words else 1)
    hot = settled(found.groupBy("g").agg(F.sum(size).alias("size")).filter(F.col("size") > wide).select("g"))
    if hot.isEmpty():
        verdict = covers(found)
    else:
        # Each window of the wide anchors' contents, as a content of its own.
        each = stored(cuts(found.join(hot, "g", "left_semi")).mapInArrow(windows_of(unit), f"s long, n long, off int, h long, first struct<{PLACE_OF}>"))
        again = each.groupBy("h").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1")
        again = stored(again.select(F.col("h").alias("s"), F.col("h").alias("g"), F.lit(1).alias("len"), "n", "first"))
        known = again.select("s", F.col("first").alias("earliest")).join(covers(again), "s").withColumnRenamed("s", "h")
        known = each.join(known, "h").withColumn("here", F.when(F.col("first") == F.col("earliest"), F.col("cover")).otherwise(F.col("rest")))
        offsets = lambda c: F.collect_list(F.when(F.size(c) > 0, F.col("off")))
        split = known.groupBy("s").agg(merged(offsets("here")).alias("cover"), merged(offsets("rest")).alias("rest"))
        verdict = covers(found.join(hot, "g", "left_anti")).union(split)

    at = hits.join(stored(found.select("s", "first").join(verdict, "s")), "s")
    cover = F.when(place == F.col("first"), F.col("cover")).otherwise(F.col("rest"))
    spans = F.transform(cover, lambda c: F.struct((F.col("a") + c["lo"]).alias("lo"), (F.col("a") + c["hi"]).alias("hi")))
    return at.select("k1", "k2", F.explode(spans).alias("span")).groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))


def covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of n values stand in a window that starts in one of ``spans``."""
    step = np.zeros(n + 1, np.int64)
    for x in spans or ():
        step[x["lo"]] += 1
        step[x["hi"] - 1 + window] -= 1
    return np.cumsum(step)[:-1] > 0
