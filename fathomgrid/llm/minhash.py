"""Near-duplicates by one-permutation MinHash with optimal densification.

A document's distinct word shingles are hashed once.  The high bits of a hash
choose one of ``rows * bands`` bins and each bin keeps its least hash; an empty bin
borrows from the bin that a fixed sequence of random draws first finds filled, so
that two sets agree in a bin as often as their Jaccard similarity says.  Documents
whose ``rows`` bins of a band agree share a bucket.

Documents with equal sets are one class and never compared.  In a bucket, classes
are linked to its centre (a star) and not to each other, and each link is confirmed
on the full sets.  Members that the stars leave outside the largest component
around a centre get a second round against the members of other components; only
components count, so within one nothing more has to be compared.  What is known there
of a member is its difference from the centre R: the shingles it lacks and those it adds.
Let D and U be the sizes of its symmetric difference from R and of its union with R, and
t the similarity asked for.  Two members x and y whose differences share s elements are
linked only if  (1 + t) s >= D(x) - (1 - t) U(x) + t D(y);  two members with nothing in
common there could only be linked if both were linked to R.  So pairs are formed under
shared elements of differences alone, by the rarest of them, and only with partners
whose D is small enough: what all members of a family share with R brings none together.
Such a pair is formed only if the parities of the two differences, dealt into bits, differ
in no more bits than linked sets may differ in shingles; this bound passes every link.

Null and empty texts, and texts of white space, have the empty set: size 0, no
links, a component of their own.  A text with fewer words than a shingle has is one
shingle.  Equal rows are the same document and get equal results.  A document whose
doc_id is null is linked like any other and gets the least doc_id of its component;
where the component has none, component_id is null and kept is true.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.llm import textkernel as tk
from fathomgrid.llm.base import components, freed, keyed, settled, stored, unstored

#: Chance that a pair at similarity 0.85 shares no bucket: (1 - 0.85**5)**28 < 1e-7; at 0.8, with 40 bands, < 1e-6.
ROWS, BANDS = 5, 28
#: Sizes of differences within this ratio are one class.
RATIO = 1.25
#: Words of 64 bits in the parities of a member's differences, at most.
MOST_WORDS = 16
#: Draws in which a bin looks for a filled one, where DataFrame functions do it.
TURNS = 32
#: White space besides the space.
SPACES = "\t\n\x0b\x0c\r"


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, lower-cased A-Z."""
    w = tk.Words(col, lower=True)
    sums = tk.prefix(w.hash)
    n = w.count
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.cumsum(size)
    doc = np.repeat(np.arange(len(n)), size)
    at = w.first[:-1][doc] + np.arange(len(doc)) - np.repeat(ends - size, size)
    shingles = tk.ranged(sums, at, np.minimum(at + k, w.first[1:][doc]))
    return [np.unique(shingles[e - s : e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]


def draws(bins: int) -> Iterator[np.ndarray]:
    """The bins in which each bin looks for a value, turn by turn: the same random draws for every set."""
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(8 * bins):
        yield rng.integers(0, bins, bins)


def signature(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Least hash of each bin, by set; empty bins densified.  Empty sets get zeros."""
    bounds = (np.arange(bins, dtype=object) * 2**64 // bins).astype(np.uint64)
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, bounds)
            full[i] = at < np.append(at[1:], len(s))
            out[i] = s[np.minimum(at, len(s) - 1)]
    some = full.any(axis=1)
    i, j = np.nonzero(~full & some[:, None])
    for turn in draws(bins):
        if not len(i):
            break
        source = turn[j]
        ok = full[i, source]
        out[i[ok], j[ok]] = tk.mix(out[i[ok], source[ok]] + tk.U(1))
        i, j = i[~ok], j[~ok]
    out[i, j] = tk.mix(out[i, np.argmax(full, axis=1)[i]] + tk.U(1))
    out[~some] = 0
    return out


def sketches(k: int, rows: int, bands: int):  # noqa: ANN201
    """A mapInArrow function: keyed documents to (k1, k2, doc_id, n, node, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = tk.mix(np.arange(1, rows + 1, dtype=np.uint64)) | tk.U(1)
        number = tk.mix(np.arange(1, bands + 1, dtype=np.uint64) * tk.U(977))
        for b in tk.slices(batches):
            sets = shingle_sets(b.column("text"), k)
            n = np.array([len(s) for s in sets], np.int64)
            node = np.array([(tk.mix(s).sum() if len(s) else 0) for s in sets], np.uint64)
            sig = signature(sets, rows * bands).reshape(len(sets), bands, rows)
            keys = tk.mix((sig * salt).sum(axis=2, dtype=np.uint64) + number)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), tk.signed(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("doc_id").cast(pa.int64()), pa.array(n), tk.signed(tk.mix(node + n.astype(np.uint64))), keys], names=["k1", "k2", "doc_id", "n", "node", "bands"])

    return run


def sets_of(k: int):  # noqa: ANN201
    """A mapInArrow function: (node, text) to (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches):
            sets = shingle_sets(b.column("text"), k)
            off = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(off), tk.signed(flat))], names=["node", "shingles"])

    return run


def native_sets(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with ``s`` in place of ``text``: sorted distinct k-word shingle hashes, lower-cased A-Z, by DataFrame functions alone.

    The hashes are others than those of ``shingle_sets``, and odd.  Here and below, each
    column that a lambda reads is named twice or more after it is made, or
    Spark would compute it anew for every element.
    """
    plain = F.translate(F.coalesce("text", F.lit("")), SPACES + ascii_uppercase, " " * len(SPACES) + ascii_lowercase)
    out = docs.withColumn("words", F.array_remove(F.split(plain, " "), "")).drop("text")
    out = out.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    # With fewer words than k the first window has them all; places beyond the end are null and add nothing.
    starts = F.greatest(F.size("h") - (k - 1), F.least(F.size("h"), F.lit(1)))
    windows = F.transform("h", lambda h, i: F.xxhash64(h, *(F.get("h", i + j) for j in range(1, k))).bitwiseOR(F.lit(1)))
    return out.withColumn("s", F.sort_array(F.array_distinct(F.slice(windows, F.lit(1), starts)))).drop("h")


def native_sketches(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """``sketches`` by DataFrame functions alone, over the hashes of ``native_sets``."""
    bins = rows * bands
    bounds = [2 * (j * 2**63 // bins) - 2**63 for j in range(bins)]  # even, so no hash; sorted in, each stands before its bin's least
    tried = [F.lit(turn.tolist()) for turn in islice(draws(bins), TURNS)]
    odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
    out = native_sets(docs, k)
    out = out.select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), F.size("s").cast("long").alias("n"), F.xxhash64("s").alias("node"), F.sort_array(F.concat("s", F.lit(bounds))).alias("m"))
    after = F.filter(F.concat("m", F.array(F.lit(0).cast("long"))), lambda _, i: (i > 0) & ~odd(F.get("m", i - 1)))
    out = out.withColumn("least", F.transform(after, lambda h: F.when(odd(h), h))).drop("m")
    out = out.withColumn("heads", F.array_compact("least"))

    def borrowed(v: Column, j: Column) -> Column:
        """The first filled bin's value; where few bins are filled, the heads are nearly the set and its least hash under j serves."""
        return F.coalesce(v, *(F.get("least", F.get(t, j)) for t in tried), F.array_min(F.transform("heads", lambda h: F.xxhash64(h, j))))

    out = out.withColumn("sig", F.transform("least", borrowed)).drop("least", "heads")
    band = F.transform(F.sequence(F.lit(0), (F.size("sig") / rows).cast("int") - 1), lambda b: F.xxhash64(b, *(F.get("sig", b * rows + i) for i in range(rows))))
    return out.select("k1", "k2", "doc_id", "n", "node", band.alias("bands"))


def parities() -> Column:
    """Differences ``d`` dealt into ``w`` words of 64 bits: whether the number in each bit is odd."""
    return F.expr("transform(sequence(0, w - 1), i -> aggregate(filter(d, h -> pmod(shiftright(h, 6), w) = i), 0L, (s, h) -> s ^ shiftleft(1L, cast(h & 63 as int))))")


def unlike(p: str, q: str) -> Column:
    """Bits in which the parities differ: never more than the sets differ in shingles."""
    return F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, c: s + c)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Links documents with 100 * |A and B| >= percent * |A or B| over their sets of
    k-word shingles; component_id is the least doc_id of the component.
    """
    return grouped(keyed(docs), k, percent, rows, bands).drop("k1", "k2", "head")


def grouped(docs: DataFrame, k: int, percent: int, rows: int, bands: int, native: bool = False) -> DataFrame:
    """``near_duplicates`` of keyed documents, with their keys and ``head``, the least key of the component (null without words).

    ``native``: no Python runs on the executors.
    """
    seen = settled(native_sketches(docs, k, rows, bands) if native else docs.mapInArrow(sketches(k, rows, bands), "k1 long, k2 int, doc_id long, n long, node long, bands array<long>"))
    key = F.struct("k1", "k2")
    classes = settled(seen.filter("n > 0").groupBy("node").agg(F.min(key).alias("key"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min_by("bands", key).alias("bands")))

    # Buckets of two classes and more, and their centres: the earliest document is the likeliest source of the others.
    spread = classes.select("node", F.col("key.k1").alias("k1"), "n", F.explode("bands").alias("b"))
    shared = settled(spread.groupBy("b").agg(F.count("*").alias("size"), F.min(F.struct("k1", "node", "n")).alias("c")).filter("size > 1").select("b", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")))
    freed(docs.sparkSession)
    members = settled(spread.drop("k1").join(shared, "b").select("b", "node", "n", "centre", "centre_n"))
    pairs = settled(members.filter(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b"), F.col("centre_n").alias("na"), F.col("n").alias("nb")).distinct())

    freed(docs.sparkSession)
    # The full sets of the classes that have a pair, and of those that may get one.
    first = settled(classes.join(members.select("node").distinct(), "node").select("node", "key.k1", "key.k2"))
    first_texts = docs.join(first, ["k1", "k2"]).select("node", "text")
    sets = stored(native_sets(first_texts, k).withColumnRenamed("s", "shingles") if native else first_texts.mapInArrow(sets_of(k), "node long, shingles array<long>"))
    passing = [sets]

    def compared(pairs: DataFrame) -> DataFrame:
        """``pairs`` with the size of the intersection, and whether it is enough."""
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
        return settled(both.withColumn("linked", enough(F.col("common"), F.col("na"), F.col("nb"))).distinct())

    def enough(common: Column, n: Column, m: Column) -> Column:
        return common * 100 >= (n + m - common) * percent

    star = compared(pairs)
    edges = star.filter("linked").select("a", "b")
    comps = components(edges)
    freed(docs.sparkSession)

    # Members outside the largest component around a centre, held against the centre's other members.
    alike = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    homes = star.groupBy("b").agg(F.max(F.struct(alike, "a")).alias("h")).select("b", F.col("h.a").alias("home"))
    around = star.join(homes, "b").select("a", "na", "b", F.col("nb").alias("n"), "common", "home")
    itself = star.select("a", "na", F.col("a").alias("b"), F.col("na").alias("n"), F.col("na").cast("int").alias("common"), F.col("a").alias("home")).distinct()
    named = around.union(itself).join(comps.select(F.col("id").alias("b"), "comp"), "b", "left")
    named = settled(named.select("a", "na", "b", "n", "common", "home", F.coalesce("comp", "b").alias("comp")))
    main = named.groupBy("a", "comp").agg(F.count("*").alias("c")).groupBy("a").agg(F.max(F.struct("c", "comp")).alias("main"))
    named = named.filter("a != b")  # the star has compared the centre
    x = settled(named.join(settled(main), "a").filter("comp != main.comp").select("a", F.col("b").alias("x"), F.col("na"), F.col("n").alias("nx"), F.col("common").alias("rx"), F.col("comp").alias("cx"), F.col("home").alias("hx")))
    if not x.isEmpty():
        named = settled(named.join(x.select("a").distinct(), "a", "left_semi"))
        # Two members whose likest centre is the same one meet there only.
        apart = (F.col("comp") != F.col("cx")) & ((F.col("home") != F.col("hx")) | (F.col("home") == F.col("a")))
        t = percent / 100
        class_of = lambda d: F.log(d) / float(np.log(RATIO))
        centres, theirs = sets.select(F.col("node").alias("a"), F.col("shingles").alias("r")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("s"))
        lacks = F.transform(F.array_except("r", "s"), lambda h: F.xxhash64(h))
        words = F.least(F.lit(MOST_WORDS), F.ceil(F.col("na") / 64).cast("int"))
        whole = stored(named.join(theirs, "b").join(centres, "a").select("a", "b", "comp", words.alias("w"), F.concat(F.array_except("s", "r"), lacks).alias("d")))
        bits = settled(whole.select("a", "b", parities().alias("bits")))  # before the differences become rows
        differs = whole.select("a", "b", "comp", F.explode("d").alias("h"))
        shared = stored(differs.groupBy("a", "h").agg(F.count("*").alias("c"), F.min("comp").alias("l"), F.max("comp").alias("m")).filter("l != m").select("a", "h", "c"))
        size = F.col("n") + F.col("na") - 2 * F.col("common")
        differs = differs.drop("comp").join(shared, ["a", "h"]).join(named.withColumn("j", F.floor(class_of(size))).join(bits, ["a", "b"]), ["a", "b"])
        differs = stored(differs.select("a", "b", "h", "c", "n", "common", "comp", "home", "j", "bits"))
        for done in (whole, shared):
            unstored(done)
        # Of x's elements that others have, a partner of class j shares at least ``least``: the rarest but least - 1 hold one.
        mine = Window.partitionBy("a", "x")
        other = x.join(differs.select("a", F.col("b").alias("x"), "h", "c", F.col("bits").alias("bx")), ["a", "x"])
        other = other.withColumns({"place": F.row_number().over(mine.orderBy("c", "h")), "of": F.count("*").over(mine)})
        union = F.col("nx") + F.col("na") - F.col("rx")
        other = other.withColumn("base", union - F.col("rx") - (1 - t) * union)
        low = F.floor(class_of(F.greatest(F.col("base"), F.lit(1.0))) - 1e-9)
        high = F.floor(class_of(F.greatest(((1 + t) * F.col("of") - F.col("base")) / t, F.lit(0.5))) + 1e-9)
        other = other.select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("j"))
        least = F.greatest(F.ceil((F.col("base") + t * F.pow(F.lit(RATIO), F.col("j"))) / (1 + t) - 1e-6), F.ceil(F.col("base") - 1e-6), F.lit(1))
        other = stored(other.filter(F.col("place") <= F.col("of") - least + 1).select("a", "h", "j", "x", "nx", "rx", "cx", "hx", "bx"))
        passing += [differs, other]
        most = F.least("rx", "common") + F.least(F.col("nx") - F.col("rx"), F.col("n") - F.col("common"))
        near = unlike("bits", "bx") * (100 + percent) <= (F.col("n") + F.col("nx")) * (100 - percent)
        against = differs.join(other, ["a", "h", "j"]).filter(apart & enough(most, F.col("nx"), F.col("n")) & enough(F.least("nx", "n"), F.col("nx"), F.col("n")) & near)
        p, q = F.struct(F.col("x").alias("v"), F.col("nx").alias("n")), F.struct(F.col("b").alias("v"), F.col("n").alias("n"))
        ends = against.select(F.least(p, q).alias("l"), F.greatest(p, q).alias("g")).distinct()
        more = compared(settled(ends.select(F.col("l.v").alias("a"), F.col("g.v").alias("b"), F.col("l.n").alias("na"), F.col("g.n").alias("nb"))))
        more = more.filter("linked").select("a", "b")
        if not more.isEmpty():
            comps = components(edges.union(more))

    placed = classes.select("node", "least", "key").join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = placed.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("key").alias("head"))
    of = settled(placed.join(lowest, "comp").select("node", "component_id", "head"))
    out = seen.select("k1", "k2", "doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    for done in passing:
        unstored(done)
    freed(docs.sparkSession)
    return out.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(component.isNull(), True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"), "head")
