"""Links between files: references, imports, suggestions, co-change, and changes of a tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions.text import plausible_path, pointer_escape
from fathomgrid.operators.graph import prefixes


def symbols_with(symbols: DataFrame, query: str, column: str = "id") -> DataFrame:
    """Symbols whose id holds the query, case ignored."""
    return symbols.filter(F.lower(column).contains(query.lower()))


def json_pointers(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pointer, value) of the top-level members of JSON objects."""
    pairs = rows.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("k", "value"))
    return pairs.select(key, F.concat(F.lit("/"), pointer_escape(F.col("k"))).alias("pointer"), "value")


def csv_columns(headers: DataFrame, key: str, column: str = "line") -> DataFrame:
    """(key, pos, name) of the columns that a header line names."""
    line = F.regexp_replace(column, "^\ufeff", "")
    each = headers.select(key, F.posexplode(F.split(line, ",")).alias("pos", "name"))
    return each.select(key, F.col("pos").cast("long").alias("pos"), F.regexp_replace(F.trim("name"), '^"+|"+$', "").alias("name")).filter("name != ''")


def snapshot_diff(old: DataFrame, new: DataFrame, values: list[str]) -> DataFrame:
    """(path, change) between two states of a tree: Added, Removed or Modified."""
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    differs = reduce(lambda x, y: x | y, [~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    change = F.when(F.col("a.path").isNull(), "Added").when(F.col("b.path").isNull(), "Removed").when(differs, "Modified")
    return j.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).filter("change is not null")


def batch_changes(batch: DataFrame, exists: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change) of a batch of touched paths, by whether they exist and are known; neither: nothing to do."""
    flags = batch.select("path").distinct().join(exists.select("path", F.lit(True).alias("e")), "path", "left").join(known.select("path", F.lit(True).alias("k")), "path", "left")
    change = F.when(F.col("e") & F.col("k"), "Modified").when(F.col("e"), "Added").when(F.col("k"), "Removed")
    return flags.select("path", change.alias("change")).filter("change is not null")


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, first_ts, last_ts, n): events of a key with less than ``gap`` between them are one batch."""
    each = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return each.drop("w")


def unique_matches(mentions: DataFrame, names: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, token, mentions): tokens that name exactly one target."""
    unique = names.groupBy("token").agg(F.min(target).alias(target), F.max(target).alias("_x")).filter(F.col(target) == F.col("_x")).drop("_x")
    counted = mentions.groupBy(source, "token").agg(F.count("*").alias("mentions"))
    return counted.join(unique, "token").select(source, target, "token", "mentions")


def best_token(matches: DataFrame, source: str, target: str) -> DataFrame:
    """The token of most mentions for each pair, ties by token."""
    w = Window.partitionBy(source, target).orderBy(F.desc("mentions"), "token")
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cochanged(commits: DataFrame, least: int = 5, most_files: int = 12) -> DataFrame:
    """(a, b, n): files changed together in ``least`` commits or more of 2 to ``most_files`` files."""
    files = commits.select("commit", "file").distinct()
    sized = files.groupBy("commit").agg(F.count("*").alias("c")).filter(F.col("c").between(2, most_files)).select("commit")
    few = files.join(sized, "commit", "left_semi")
    pairs = few.select("commit", F.col("file").alias("a")).join(few.select("commit", F.col("file").alias("b")), "commit").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def path_references(strings: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): strings (source, value) that are the path of another file."""
    few = strings.filter(plausible_path(F.col("value"))).filter("value != source").select("source", F.col("value").alias("path")).distinct()
    return few.join(files.select("path").distinct(), "path", "left_semi").select("source", F.col("path").alias("target"))


def first_candidate(specs: DataFrame, base: Column, suffixes: list[str], files: DataFrame) -> DataFrame:
    """``specs`` with ``target``: the first of base + suffix that is a file; specs without one drop out."""
    options = F.array(*[F.concat(base, F.lit(s)) for s in suffixes])
    each = specs.select("*", F.posexplode(options).alias("_pos", "path")).join(files.select("path").distinct(), "path", "left_semi")
    return each.groupBy(*specs.columns).agg(F.min_by("path", "_pos").alias("target"))


def nearest_ancestor(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the deepest proper ancestor of each file that is in ``roots``."""
    each = files.select("path", F.explode(prefixes(F.col("path"))).alias("root")).filter("root != path")
    return each.join(roots, "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def call_categories(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls with ``category``: UNIQUE, AMBIG or EXTERN by the number of definitions (token, defs)."""
    j = calls.join(definitions, "token", "left")
    return j.withColumn("category", F.when(F.col("defs").isNull(), "EXTERN").when(F.col("defs") == 1, "UNIQUE").otherwise("AMBIG"))


def call_confusion(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(kind, UNIQUE, AMBIG, EXTERN): counts of calls (kind, token) by category."""
    each = call_categories(calls, definitions).groupBy("kind").pivot("category", ["UNIQUE", "AMBIG", "EXTERN"]).agg(F.count(F.lit(1)))
    return each.fillna(0)
