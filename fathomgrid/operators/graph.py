"""The link graph: containment, neighbours, hints, rename chains, visible parts."""

from __future__ import annotations

import gc
import tempfile
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def prefixes(path: Column) -> Column:
    """The path's ancestors from the root ``""`` to the path itself."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)).otherwise("")


def nodes(files: DataFrame, time: str | None = None) -> DataFrame:
    """(id, label, kind, ext[, time]) of all folders and files; a folder's time is its earliest file's."""
    when = [F.col(time).alias("time")] if time else []
    each = files.select("path", *when, F.explode(prefixes(F.col("path"))).alias("id"))
    is_file = F.max(F.col("id") == F.col("path"))
    out = each.groupBy("id").agg(F.when(is_file, "file").otherwise("folder").alias("kind"), *([F.min("time").alias("time")] if time else []))
    name = F.substring_index("id", "/", -1)
    ext = F.when((F.col("kind") == "file") & name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return out.select("id", name.alias("label"), "kind", ext.alias("ext"), *(["time"] if time else []))


def contains(files: DataFrame) -> DataFrame:
    """(source, target, rel) from each folder to what is in it."""
    each = files.select(F.explode(prefixes(F.col("path"))).alias("target")).filter("target != ''").distinct()
    return each.select(parent(F.col("target")).alias("source"), "target", F.lit("contains").alias("rel"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree), both ends of an edge counted."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def visible(edges: DataFrame, limit: int) -> DataFrame:
    """(source, target, rel) among the ``limit`` nodes of highest degree."""
    best = degree(edges).orderBy(F.desc("degree"), "id").limit(limit).select("id")
    return edges.join(best.withColumnRenamed("id", "source"), "source", "left_semi").join(best.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "rel")


def hints(edges: DataFrame) -> DataFrame:
    """(id, direction, rel, n): how many links of each kind leave and enter a node."""
    out = edges.select(F.col("source").alias("id"), F.lit("out").alias("direction"), "rel")
    into = edges.select(F.col("target").alias("id"), F.lit("in").alias("direction"), "rel")
    return out.unionByName(into).groupBy("id", "direction", "rel").agg(F.count("*").alias("n"))


def hint_maps(edges: DataFrame) -> DataFrame:
    """(id, out, in) with the counts as maps from rel."""
    each = hints(edges).groupBy("id", "direction").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rel", "n")))).alias("m"))
    return each.groupBy("id").pivot("direction", ["out", "in"]).agg(F.first("m"))


def neighbors(edges: DataFrame, start: list[str], depth: int = 1, direction: str = "both", rels: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, depth) reached within 1 to 5 steps, the start left out, each at its least depth.

    With a limit no further level is opened once enough are found, and the nearest
    are returned in order of depth and id.
    """
    depth = min(5, max(1, depth))
    live = edges.filter(F.col("rel").isin(rels)) if rels else edges
    ways = []
    if direction in ("out", "both"):
        ways.append(live.select(F.col("source").alias("at"), F.col("target").alias("id")))
    if direction in ("in", "both"):
        ways.append(live.select(F.col("target").alias("at"), F.col("source").alias("id")))
    steps = reduce(DataFrame.union, ways).distinct()
    spark = edges.sparkSession
    level = spark.createDataFrame([(s,) for s in start], "id string")
    levels: list[DataFrame] = []
    for d in range(1, depth + 1):
        # A level is used twice, by the next and by the result: both read the one exchange of its ``distinct``.
        level = steps.join(level.select(F.col("id").alias("at")), "at").select("id").distinct()
        levels.append(level.withColumn("depth", F.lit(d)))
        out = reduce(DataFrame.union, levels).filter(~F.col("id").isin(start)).groupBy("id").agg(F.min("depth").alias("depth"))
        if limit is not None and d < depth and out.limit(limit).count() >= limit:
            break
    return out.orderBy("depth", "id").limit(limit) if limit is not None else out


def focused(edges: DataFrame, focus: str, confidence: tuple[str, ...] = ("certain",), rels: list[str] | None = None, depth: int = 1) -> DataFrame:
    """The edges (source, target, rel, confidence) among a node and its neighbours, of the given confidence and kinds."""
    live = edges.filter(F.col("confidence").isin(list(confidence)))
    live = live.filter(F.col("rel").isin(rels)) if rels else live
    ids = neighbors(live, [focus], depth).select("id").union(edges.sparkSession.createDataFrame([(focus,)], "id string"))
    return live.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def filtered(nodes: DataFrame, edges: DataFrame, rels: list[str] | None = None, label: str = "", folders: bool = True, orphans: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a view: kinds of links, a part of the label, with or without folders and nodes without links."""
    shown = nodes.filter(F.lower("label").contains(label.lower()))
    shown = shown if folders else shown.filter("kind != 'folder'")
    live = edges.filter(F.col("rel").isin(rels)) if rels else edges
    ids = shown.select("id")
    live = live.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    if not orphans:
        shown = shown.join(degree(live), "id", "left_semi").select(*shown.columns)
    return shown, live


def rename_closure(events: DataFrame, hops: int = 64) -> DataFrame:
    """(source, target, commit, hops) of rename chains old -> new, by their last hop; renames back to the start drop out.

    ``events``: (seq, old, new, commit); of several renames of one name the last counts.
    Chains double in length every round, so 64 hops take six joins.  A chain that runs
    into a ring of renames ends where it meets a name for the second time: at the ring's
    first name that it reached, by the ring's hop into it.
    """
    last = events.groupBy("old").agg(F.max_by(F.struct("new", "commit"), "seq").alias("e"))
    one = settled(last.select(F.col("old").alias("source"), F.col("e.new").alias("target"), F.col("e.commit").alias("commit"), F.lit(1).alias("hops")))
    link = _doubled(one, hops)
    goes_on = one.select(F.col("source").alias("target"))
    stuck = settled(link.join(goes_on, "target", "left_semi"))
    if stuck.isEmpty():
        return link.filter("source != target")
    # Hops in a ring only turn it, so that its names are what is reached after very many hops.
    ring = settled(_doubled(stuck.select("source", "target", "commit", "hops"), 64, one).join(goes_on, "target", "left_semi").select(F.col("target").alias("name")).distinct())
    inside = ring.withColumnRenamed("name", "source")
    into = one.join(inside, "source", "left_semi").groupBy("target").agg(F.min("commit").alias("into"))
    ends = _doubled(one.join(inside, "source", "left_anti"), hops).join(into, "target", "left")
    return ends.select("source", "target", F.coalesce("into", "commit").alias("commit"), "hops").filter("source != target")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the session's ``spark.checkpoint.dir``; where none is set, on one machine, in a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that are no longer referred to; twice, as the end of a query still refers to it for a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _doubled(link: DataFrame, hops: int, step: DataFrame | None = None) -> DataFrame:
    """Chains of up to ``hops`` links; ``step``: links to go on by, else their own.  Every round is kept, so that plans don't grow."""
    step, reach = link if step is None else step, 1
    while reach < hops:
        on = lambda of: of.select(F.col("source").alias("target"), F.col("target").alias("far"), F.col("commit").alias("far_commit"), F.col("hops").alias("more"))
        go = lambda of, on: settled(of.join(on, "target", "left").select("source", F.coalesce("far", "target").alias("target"), F.coalesce("far_commit", "commit").alias("commit"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        same = link is step
        link = go(link, on(step))
        step = link if same else go(step, on(step))
        reach *= 2
    return link


def fold(log: DataFrame) -> DataFrame:
    """The live records of an append-only log: the last record of an id counts, ``del`` removes it."""
    last = log.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]), F.struct("ts", "op")).alias("r"))
    return last.select("id", "r.*").filter("op != 'del'")


def first_rank(hits: DataFrame, by: str, *order: str) -> DataFrame:
    """Keeps the first row of each ``by`` in the given order."""
    w = Window.partitionBy(by).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
