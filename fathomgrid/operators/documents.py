"""Structure of text documents in the JVM: lines, fences, sections, underlined titles, broken references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line, start): lines with their byte offsets."""
    each = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("*", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)).cast("long").alias("start"))


def fenced(rows: DataFrame, key: str, fence: Column) -> DataFrame:
    """``rows`` with ``inside``: whether an odd number of fence lines stands before."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum(fence.cast("int")).over(w), F.lit(0)) % 2 == 1)


def sections(heads: DataFrame, key: str, levels: int = 6) -> DataFrame:
    """``heads`` (key, level, start) with ``end``: the next heading of the same level or above, else null."""
    after = Window.partitionBy(key).orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.when(F.col("level") == n, F.min(F.when(F.col("level") <= n, F.col("start"))).over(after)) for n in range(1, levels + 1)]
    return heads.withColumn("end", F.coalesce(*ends))


def titles(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, title) of lines with an underline of one character, long enough, below them."""
    w = Window.partitionBy(key).orderBy("pos")
    under = F.rtrim(F.lead("line").over(w))
    each = rows.select(key, "pos", F.trim("line").alias("title"), under.alias("under"))
    return each.filter((F.col("title") != "") & F.col("under").rlike(r"^([=\-~^\"'#*+.:_])\1*$") & (F.length("under") >= F.length("title"))).select(key, "pos", "title")


def dangling(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References (source, target) to what does not exist."""
    return references.distinct().join(targets, "target", "left_anti").select("source", "target")


def revealed(nodes: DataFrame, edges: DataFrame, cursor: int) -> tuple[DataFrame, DataFrame]:
    """Nodes up to a time, and the edges with both ends among them."""
    shown = nodes.filter(F.col("time") <= cursor)
    ids = shown.select("id")
    live = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, live.select(*edges.columns)


def same_top_share(pairs: DataFrame) -> DataFrame:
    """One row: the share of pairs (source, target) within one top-level folder."""
    top = lambda c: F.substring_index(c, "/", 1)
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg((top("source") == top("target")).cast("double")), 6).alias("share"))


def retarget_rules(broken: DataFrame, now: DataFrame) -> DataFrame:
    """(old_prefix, new_prefix, n): folder renames that would mend broken paths, by their common tails.

    A broken path and a file of the same name suggest the folders that differ when the
    longest common tail of segments is cut off; names of one file only count.
    """
    name = lambda c: F.substring_index(c, "/", -1)
    unique = now.groupBy(name("path").alias("name")).agg(F.min("path").alias("new"), F.count("*").alias("c")).filter("c = 1").drop("c")
    pairs = broken.select(F.col("path").alias("old"), name("path").alias("name")).join(unique, "name")
    a, b = F.reverse(F.split("old", "/")), F.reverse(F.split("new", "/"))
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    tail = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]
    cut = lambda c, n: F.array_join(F.slice(F.split(c, "/"), F.lit(1), F.greatest(F.size(F.split(c, "/")) - n, F.lit(0))), "/")
    rules = pairs.withColumn("n", tail).select(cut("old", F.col("n")).alias("old_prefix"), cut("new", F.col("n")).alias("new_prefix"))
    return rules.groupBy("old_prefix", "new_prefix").agg(F.count("*").alias("n"))


def staged(old: DataFrame, stages: list[tuple[str, DataFrame, list[str]]], last: str) -> DataFrame:
    """``old`` with (stage, target): the first stage whose table has the row's values of the given columns."""
    out = old
    for i, (_, table, on) in enumerate(stages):
        out = out.join(table.select(*on, F.col("target").alias(f"_t{i}")).dropDuplicates(on), on, "left")
    stage = reduce(lambda acc, i: acc.when(F.col(f"_t{i}").isNotNull(), stages[i][0]), range(1, len(stages)), F.when(F.col("_t0").isNotNull(), stages[0][0]))
    return out.select(*old.columns, stage.otherwise(last).alias("stage"), F.coalesce(*[f"_t{i}" for i in range(len(stages))]).alias("target"))
