"""Address resolution: where an old address points now, by ladders of ever weaker evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions.text import shingles, sketch, tokens
from fathomgrid.operators.documents import staged
from fathomgrid.operators.graph import freed, settled


def file_ladder(old: DataFrame, now: DataFrame, alias: DataFrame) -> DataFrame:
    """``old`` with (stage, target): F1 path, F1a path without case, F2 alias, L3 unique name, L3a ambiguous, BROKEN."""
    same = now.select("path", F.col("path").alias("t1"))
    folded = now.groupBy(F.lower("path").alias("_low")).agg(F.min("path").alias("t1a"))
    moved = alias.join(now.select(F.col("path").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("path")).agg(F.min("target").alias("t2"))
    names = now.groupBy(F.substring_index("path", "/", -1).alias("_name")).agg(F.min("path").alias("t3"), F.count("*").alias("_n"))
    j = old.withColumns({"_low": F.lower("path"), "_name": F.substring_index("path", "/", -1)})
    j = j.join(same, "path", "left").join(folded, "_low", "left").join(moved, "path", "left").join(names, "_name", "left")
    stage = F.when(F.col("t1").isNotNull(), "F1").when(F.col("t1a").isNotNull(), "F1a").when(F.col("t2").isNotNull(), "F2").when(F.col("_n") == 1, "L3").when(F.col("_n") > 1, "L3a").otherwise("BROKEN")
    return j.select(*old.columns, stage.alias("stage"), F.coalesce("t1", "t1a", "t2", F.when(F.col("_n") == 1, F.col("t3"))).alias("target"))


def symbol_ladder(old: DataFrame, now: DataFrame, alias: DataFrame) -> DataFrame:
    """``old`` (path, sym) with (stage, target): S1 same place, S2 renamed file, S3 unique name, S3a ambiguous, GONE."""
    s = now.select("path", "sym").distinct()
    one = s.select("path", "sym", F.col("path").alias("t1"))
    moved = alias.select(F.col("source").alias("path"), F.col("target").alias("t2"))
    two = moved.join(s.select(F.col("path").alias("t2"), "sym"), "t2").groupBy("path", "sym").agg(F.min("t2").alias("t2"))
    names = s.groupBy("sym").agg(F.min("path").alias("t3"), F.count("*").alias("_n"))
    j = old.join(one, ["path", "sym"], "left").join(two, ["path", "sym"], "left").join(names, "sym", "left")
    stage = F.when(F.col("t1").isNotNull(), "S1").when(F.col("t2").isNotNull(), "S2").when(F.col("_n") == 1, "S3").when(F.col("_n") > 1, "S3a").otherwise("GONE")
    return j.select(*old.columns, stage.alias("stage"), F.coalesce("t1", "t2", F.when(F.col("_n") == 1, F.col("t3"))).alias("target"))


def symbol_ladder_full(old: DataFrame, now: DataFrame, alias: DataFrame, found: float = 0.4, gone: float = 0.2) -> DataFrame:
    """``old`` (path, sym, text) with (stage, target): ``symbol_ladder``, and S4 or S5 where it says GONE.

    S4: a symbol of the tree whose text is as similar as ``found``; S5: only as similar as
    ``gone``, so that it exists but can't be told; both by sketch votes and exact shingles.
    """
    first = symbol_ladder(old, now, alias)
    ident = F.concat_ws("#", "path", "sym").alias("id")
    lost = first.filter("stage = 'GONE'").select(ident, "text").distinct()
    near = sketch_matches(lost, now.select(ident, "text").distinct(), threshold=gone)
    named = first.withColumn("id", F.concat_ws("#", "path", "sym")).join(near, "id", "left")
    stage = F.when(F.col("stage") != "GONE", F.col("stage")).when(F.col("jaccard") >= found, "S4").when(F.col("jaccard") >= gone, "S5").otherwise("GONE")
    target = F.when(F.col("stage") != "GONE", F.col("target")).when(F.col("jaccard") >= found, F.substring_index("match", "#", 1))
    return named.select(*old.columns, stage.alias("stage"), target.alias("target"))


def heading_ladder(old: DataFrame, now: DataFrame) -> DataFrame:
    """``old`` (path, slug, hint) with (stage, target): H1 same slug in the file, H2 a heading of the hinted text there, H3 broken."""
    same = now.select("path", "slug", F.col("slug").alias("target"))
    text = now.groupBy("path", F.col("title").alias("hint")).agg(F.min_by("slug", "pos").alias("target"))
    return staged(old, [("H1", same, ["path", "slug"]), ("H2", text, ["path", "hint"])], "H3")


def column_ladder(old: DataFrame, now: DataFrame) -> DataFrame:
    """``old`` (path, name) with (stage, target): C1 a column of that name in the file, C2 broken."""
    return staged(old, [("C1", now.select("path", "name", F.col("name").alias("target")), ["path", "name"])], "C2")


def row_ladder(old: DataFrame, now: DataFrame) -> DataFrame:
    """``old`` (path, n, hint) with (stage, target): I1 the row or cell of that number has the hint, I2 the first one of the file that has it, I3 broken."""
    same = now.select("path", "n", "hint", F.col("n").alias("target"))
    moved = now.groupBy("path", "hint").agg(F.min("n").alias("target"))
    return staged(old, [("I1", same, ["path", "n", "hint"]), ("I2", moved, ["path", "hint"])], "I3")


def row_hint(first: Column, row: Column) -> Column:
    """The anchor of a row: its first value and a short hash of it all."""
    return F.concat_ws(":", first, F.substring(F.sha2(row, 256), 1, 8))


def jaccard_within(sets: DataFrame, group: str, key: str) -> DataFrame:
    """(group, a, b, jaccard) of the pairs a < b of a group that share an element of their sets ``s``."""
    sized = sets.select(group, key, F.size("s").alias("n"), F.explode("s").alias("g"))
    a, b = sized.select(group, F.col(key).alias("a"), "g", F.col("n").alias("na")), sized.select(group, F.col(key).alias("b"), "g", F.col("n").alias("nb"))
    both = a.join(b, [group, "g"]).filter("a < b").groupBy(group, "a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return both.select(group, "a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


def sketch_matches(left: DataFrame, right: DataFrame, k: int = 3, size: int = 32, most: int = 200, candidates: int = 40, threshold: float = 0.4, others: bool = False) -> DataFrame:
    """(id, match, jaccard): each left text's best right text by sketch votes, then exact shingle similarity.

    Sketch values that more than ``most`` right texts have don't vote, and the
    ``candidates`` with most votes are compared: both are the measured design.
    ``others``: a text is not its own match.

    Texts of equal sets are one class.  Full sets are made only of classes in a
    pair that may reach ``threshold`` by its bounds, which lose none: sizes, then
    bit maps of the sets.
    """
    x = _printed(left, k, size)
    y = x if left is right else _printed(right, k, size)
    prepared = lambda df: df.select("id", F.explode("v").alias("h")).filter("h != 4294967295")
    votes = prepared(y).withColumnRenamed("id", "match")
    rare = votes.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") <= most).select("h")
    pairs = prepared(x).join(votes.join(rare, "h", "left_semi"), "h").groupBy("id", "match").agg(F.count("*").alias("votes"))
    pairs = pairs.filter("id != match") if others else pairs
    w = Window.partitionBy("id").orderBy(F.desc("votes"), "match")
    few = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= candidates).select("id", "match")
    few = few.join(x.select("id", F.col("c").alias("a"), "n"), "id").join(y.select(F.col("id").alias("match"), F.col("c").alias("b"), F.col("n").alias("m")), "match")
    least = threshold - 1e-6  # similarities are rounded before they are held against the threshold
    few = few.filter(_similar(F.least("n", "m"), F.col("n"), F.col("m")) >= least)
    if left is right:  # a pair of classes is compared once
        few = few.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    few = settled(few.select("id", "match", "a", "b"))
    del votes, rare, pairs
    freed(left.sparkSession)
    classes = lambda df, c, n, bits: df.groupBy(F.col("c").alias(c)).agg(F.first("n").alias(n), F.first("bits").alias(bits))
    drawn = few.select("a", "b").distinct().join(classes(x, "a", "n", "p"), "a").join(classes(y, "b", "m", "q"), "b")
    common = F.greatest("n", "m") - F.when(F.col("n") >= F.col("m"), _outside(F.col("p"), F.col("q"))).otherwise(_outside(F.col("q"), F.col("p")))
    near = settled(drawn.filter(_similar(common, F.col("n"), F.col("m")) >= least).select("a", "b", "n"))
    del drawn
    freed(left.sparkSession)
    apart = near.filter("a != b").select("a", "b")
    if left is right:
        p = q = _sets_of(left, x, apart.select(F.explode(F.array("a", "b")).alias("c")), k)
    else:
        p, q = _sets_of(left, x, apart.select(F.col("a").alias("c")), k), _sets_of(right, y, apart.select(F.col("b").alias("c")), k)
    full = apart.join(p.select(F.col("c").alias("a"), F.col("s").alias("p")), "a").join(q.select(F.col("c").alias("b"), F.col("s").alias("q")), "b")
    score = _similar(F.size(F.array_intersect("p", "q")), F.size("p"), F.size("q"))
    same = near.filter("a = b").select("a", "b", F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("jaccard"))
    scored = full.select("a", "b", F.round(score, 6).alias("jaccard")).union(same).filter(F.col("jaccard") >= threshold)
    found = few.join(scored, ["a", "b"]).select("id", "match", "jaccard")
    best = Window.partitionBy("id").orderBy(F.desc("jaccard"), "match")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


#: Texts whose ids go to every task; of more, they are joined.
SENT = 200_000


def _sets_of(texts: DataFrame, prints: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(c, s): the full set of each class, from one of its texts."""
    ids = settled(prints.join(classes.distinct(), "c", "left_semi").groupBy("c").agg(F.min("id").alias("id")).select("id").distinct())
    ids = F.broadcast(ids) if ids.count() <= SENT else ids  # else all texts are shuffled to find the few
    made = texts.join(ids, "id", "left_semi").select(_set(F.col("text"), k).alias("s"))
    return made.select(F.aggregate("s", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h)).alias("c"), "s").dropDuplicates(["c"])


def _set(source: Column, k: int) -> Column:
    """The distinct shingles of a text, by 64-bit hashes."""
    return F.array_distinct(F.transform(shingles(tokens(source), k), lambda g: F.xxhash64(g)))


def _similar(common: Column, n: Column, m: Column) -> Column:
    """Jaccard similarity of sets of n and m that have ``common`` elements in common."""
    return common / F.greatest(n + m - common, F.lit(1))


def _outside(larger: Column, smaller: Column) -> Column:
    """At least so many elements of one set are not in another, by their bit maps; the first has as many words or a multiple."""
    alone = F.transform(larger, lambda word, i: F.bit_count(word.bitwiseAND(F.bitwise_not(F.get(smaller, (i % F.size(smaller)).cast("int"))))))
    return F.aggregate(alone, F.lit(0), lambda a, b: a + b)


def _printed(texts: DataFrame, k: int, size: int) -> DataFrame:
    """(id, v, c, n, bits) of (id, text): the sketch, and of the set of shingles a 64-bit hash, its size, and a map of four to eight bits for each.

    Kept, so that texts are cut once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column("s")
            n = np.diff(s.offsets.to_numpy())
            hashes = s.flatten().to_numpy()
            c = np.append(0, np.bitwise_xor.accumulate(hashes))[np.append(0, np.cumsum(n))]
            words = 1 << np.ceil(np.log2(np.maximum(n / 16, 1))).astype(np.int64)
            ends = np.cumsum(words)
            flags = np.zeros(64 * int(words.sum()), np.bool_)
            flags[np.repeat(64 * (ends - words), n) + (hashes & np.repeat(64 * words - 1, n))] = True
            bits = np.packbits(flags, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(c[1:] ^ c[:-1]), pa.array(n, pa.int32()), pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), bits)], ["id", "v", "c", "n", "bits"])

    cut = texts.filter("text IS NOT NULL").select("id", F.array_distinct(sketch(F.col("text"), k, size)).alias("v"), _set(F.col("text"), k).alias("s"))
    kind = cut.schema["id"].dataType.simpleString()
    return settled(cut.mapInArrow(run, f"id {kind}, v array<bigint>, c bigint, n int, bits array<bigint>"))
