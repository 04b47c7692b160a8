"""Keeping the index of a tree up to date: batches of changes, and a stream of them.

A watcher's events are hints: each batch is reduced to distinct paths, their change is
inferred from what exists and what is known, and rows of changed paths are replaced.
Reconciling with a fresh snapshot finds whatever the events missed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomgrid.functions import address
from fathomgrid.operators import links, search
from fathomgrid.sources import parsers

OWN = [".vault", ".vault-ai"]


def outside_storage(batch: DataFrame) -> DataFrame:
    """Paths that are not in the engine's own folders."""
    return batch.filter(~F.substring_index("path", "/", 1).isin(OWN))


def replaced(table: DataFrame, changed: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``table`` with the rows of changed keys replaced by ``new``."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def applied(files: DataFrame, batch: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file table after a batch of touched paths, the changes), given the tree as it is now."""
    changes = links.batch_changes(outside_storage(batch), exists=now, known=files)
    fresh = now.join(changes.filter("change != 'Removed'").select("path"), "path", "left_semi")
    return replaced(files, changes, fresh), changes


#: Files whose edits change derived links, and suggestions.  Fixed values.
DERIVED, SUGGESTED = ["json", "yaml", "yml", "toml", "ts", "tsx", "js", "py", "rs"], ["md", "py", "go", "rs", "ts"]


def refreshes(changes: DataFrame, *by: str) -> DataFrame:
    """(by, derived, suggested): whether a batch of (path, change) calls for derived links or suggestions anew.

    Edits count by the file's extension; what appears or goes away always does.
    """
    ext = F.when(F.substring_index("path", "/", -1).contains("."), F.lower(F.substring_index("path", ".", -1)))
    other = F.col("change") != "Modified"
    any_of = lambda kinds: F.coalesce(F.bool_or(other | F.coalesce(ext.isin(kinds), F.lit(False))), F.lit(False))
    return changes.groupBy(*by).agg(any_of(DERIVED).alias("derived"), any_of(SUGGESTED).alias("suggested"))


def storms(batch: DataFrame, most: int = 1000) -> DataFrame:
    """(root): top-level folders with more than ``most`` touched paths, which are scanned again instead of followed."""
    return batch.select("path").distinct().groupBy(F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("").alias("root")).agg(F.count("*").alias("n")).filter(F.col("n") > most).select("root")


def reindexed(postings: DataFrame, lengths: DataFrame, symbols: DataFrame, changes: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, lengths and symbols after changes (path, change): only the changed paths of ``content`` are read again."""
    fresh = content.join(changes.filter("change != 'Removed'").select("path"), "path", "left_semi")
    parsed = parsers.symbols(fresh)
    more = [c for c in symbols.columns if c not in parsed.columns]
    parsed = parsed.withColumn("uri", address.symbol_address(F.col("path"), F.col("node_type"), F.col("id"))) if more == ["uri"] else parsed
    return replaced(postings, changes, search.postings(fresh, "text", "path")), replaced(lengths, changes, search.lengths(fresh, "text", "path")), replaced(symbols, changes, parsed.select(*symbols.columns))


def touched(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, modified) of the files that appear or change below a folder, for ``watch``."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(folder)
    return stream.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), F.col("modificationTime").alias("modified"))


def reconciled(files: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file table, changes) by comparing size and time of everything."""
    changes = links.snapshot_diff(files.select("path", "size", "mtime_ns"), now.select("path", "size", "mtime_ns"), ["size", "mtime_ns"])
    fresh = now.join(changes.filter("change != 'Removed'").select("path"), "path", "left_semi")
    return replaced(files, changes, fresh), changes


def watch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "200 milliseconds", once: bool = False) -> StreamingQuery:
    """Calls ``handle`` with the distinct paths of each batch of a stream of (path)."""

    def batch(df: DataFrame, number: int) -> None:
        handle(outside_storage(df.select("path")).distinct(), number)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def debounced_stream(events: DataFrame, ts: str, gap: str, late: str) -> DataFrame:
    """Batches of a stream: paths with less than ``gap`` between their events, closed ``late`` after event time."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy("path", w.alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("first_ts"), F.col("w.end").alias("closed_ts"), "n")
