"""Suggested and derived links of a tree of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions.text import compound, decision_key, inline_code, looks_like_identifier
from fathomgrid.operators import links
from fathomgrid.operators.graph import parent

#: Kinds of symbols that documentation describes.  Fixed values.
CODE_KINDS = ["function", "method", "class", "struct", "enum", "trait", "interface"]
CONFIG, SOURCES = ["json", "yaml", "yml", "toml"], ["py", "rs", "ts"]
TS_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]


def ext(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def code_tokens(content: DataFrame) -> DataFrame:
    """(path, token) of inline code in markdown outside fences."""
    lines = content.filter(ext(F.col("path")) == "md").select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    fence = F.ltrim("line").startswith("```") | F.ltrim("line").startswith("~~~")
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.sum(fence.cast("int")).over(w), F.lit(0)) % 2 == 1
    return lines.withColumn("fenced", open_ | fence).filter("not fenced").select("path", F.explode(inline_code(F.col("line"))).alias("token"))


def described(content: DataFrame, symbols: DataFrame, dictionary: DataFrame | None = None, loose: bool = False) -> DataFrame:
    """R1: (from, to, rel, origin, confidence, token, mentions): inline code that names a symbol of exactly one file.

    Plain words that the dictionary (word) knows are left out; ``loose`` cuts calls
    and qualifiers off the token first.
    """
    said = code_tokens(content)
    if loose:
        bare = F.substring_index(F.regexp_replace("token", r"\(.*$", ""), ".", -1)
        said = said.withColumn("token", bare).filter(F.col("token").rlike(r"^[A-Za-z_]\w*$") & (F.length("token") >= 4))
    names = symbols.filter(F.col("node_type").isin(CODE_KINDS)).select(F.col("path").alias("target"), F.substring_index("id", ".", -1).alias("token"))
    found = links.unique_matches(said.withColumnRenamed("path", "source"), names, "source", "target").filter("source != target")
    if dictionary is not None:
        plain = dictionary.select(F.lower("word").alias("low")).distinct()
        found = found.withColumn("low", F.when(~compound(F.col("token")), F.lower("token"))).join(plain, "low", "left_anti").drop("low")
    best = links.best_token(found, "source", "target")
    best = best.orderBy(F.desc(compound(F.col("token"))), F.desc(F.octet_length("token")), F.desc("mentions"), "source", "target")
    return best.select(F.col("source").alias("from"), F.col("target").alias("to"), F.lit("describes").alias("rel"), F.lit("suggested").alias("origin"), F.lit("probable").alias("confidence"), "token", "mentions")


def plain_word(token: Column, dictionary: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of ``tokens`` whose token is no English word by the dictionary (word), endings s, es, ed and ing apart.

    Kept are identifiers of four characters or more that are compound or unknown.
    """
    words = dictionary.select(F.lower("word").alias("_stem")).distinct()
    low = F.lower(token)
    joint = token.contains("_") | token.rlike("[a-z][A-Z]|[A-Z]{2,}[a-z]|[0-9]")
    stems = F.array(low, *[F.when(low.endswith(e), F.substring(low, F.lit(1), F.length(low) - len(e))) for e in ("s", "es", "ed", "ing")])
    named = tokens.filter(token.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.length(token) >= 4)).withColumn("_row", F.monotonically_increasing_id()).withColumn("_joint", joint)
    known = named.filter(~F.col("_joint")).select("_row", F.explode(stems).alias("_stem")).join(words, "_stem", "left_semi").select("_row").distinct()
    return named.join(known, "_row", "left_anti").select(*tokens.columns)


def rare_in_prose(tokens: DataFrame, prose: DataFrame, most: int = 3) -> DataFrame:
    """Rows of ``tokens`` (token) that stand at most ``most`` times as words of ``prose`` (text)."""
    words = prose.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("token"))
    common = words.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("token")
    return tokens.join(common, "token", "left_anti").select(*tokens.columns)


PATH_LIKE = r'"([A-Za-z0-9_./\-]{4,120}\.[A-Za-z0-9]{1,6})"'


def referenced_from(content: DataFrame, files: DataFrame) -> DataFrame:
    """R2 over the text of settings files: quoted strings like paths, from the file's own folder or else from the root."""
    few = content.filter(ext(F.col("path")).isin(CONFIG)).select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(PATH_LIKE), F.lit(1))).alias("value"))
    few = few.filter(~F.col("value").startswith("http") & ~F.col("value").startswith("/")).distinct()
    near = few.select("source", "value", F.posexplode(F.array(joined_path(parent(F.col("source")), F.col("value")), joined_path(F.lit(""), F.col("value")))).alias("pos", "path"))
    hit = near.join(files.select("path").distinct(), "path", "left_semi").groupBy("source", "value").agg(F.min_by("path", "pos").alias("target"))
    return _link(hit.filter("source != target").select("source", "target"), "references", "extracted")


def undecided(candidates: DataFrame, decisions: DataFrame, rule: str = "R1") -> DataFrame:
    """Candidates that nobody has accepted or rejected."""
    return candidates.withColumn("key", decision_key(F.lit(rule), F.col("from"), F.col("to"))).join(decisions.select("key").distinct(), "key", "left_anti")


def referenced(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """R2: (from, to, rel, origin, confidence): strings in settings files that are paths of other files."""
    leaves = symbols.filter(ext(F.col("path")).isin(CONFIG) & (F.col("node_type") == "string"))
    strings = leaves.select(F.col("path").alias("source"), F.from_json(F.concat(F.lit('{"v":'), "source", F.lit("}")), "v string")["v"].alias("value"))
    return _link(links.path_references(strings, files), "references", "extracted")


def _link(pairs: DataFrame, rel: str, origin: str, confidence: str = "certain") -> DataFrame:
    return pairs.select(F.col("source").alias("from"), F.col("target").alias("to"), F.lit(rel).alias("rel"), F.lit(origin).alias("origin"), F.lit(confidence).alias("confidence")).distinct()


def joined_path(base: Column, spec: Column) -> Column:
    """``spec`` from folder ``base``: ``.`` stays, ``..`` goes up and stops at the root."""
    start = F.filter(F.split(base, "/"), lambda p: p != "")
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(spec, "/"), start, step), "/")


def imported(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from, to, rel, origin, confidence): imports that lead to a file of the tree.

    TypeScript resolves relative specs, Python those with leading dots and a name, and
    Rust modules and ``crate::`` paths below the nearest manifest, deepest first.
    """
    rows = imports.select(F.col("path").alias("source"), "spec", ext(F.col("path")).alias("ext"), parent(F.col("path")).alias("folder"))
    ts = rows.filter((F.col("ext") == "ts") & F.col("spec").rlike(r"^\.\.?/")).select("source", joined_path(F.col("folder"), F.col("spec")).alias("base"))
    out = links.first_candidate(ts, F.col("base"), TS_SUFFIXES, files).select("source", "target")
    py = rows.filter((F.col("ext") == "py") & F.col("spec").rlike(r"^\.+[^.]"))
    ups = F.repeat(F.lit("../"), F.length(F.regexp_extract("spec", r"^(\.+)", 1)) - 1)
    py = py.select("source", joined_path(F.col("folder"), F.concat(ups, F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/")))).alias("base"))
    out = out.union(links.first_candidate(py, F.col("base"), [".py", "/__init__.py"], files).select("source", "target"))
    rs = rows.filter(F.col("ext") == "rs")
    mods = rs.filter(F.col("spec").startswith("mod:")).select("source", joined_path(F.col("folder"), F.substring("spec", 5, 1 << 20)).alias("base"))
    out = out.union(links.first_candidate(mods, F.col("base"), [".rs", "/mod.rs"], files).select("source", "target"))
    roots = files.filter((F.col("path") == "Cargo.toml") | F.col("path").endswith("/Cargo.toml")).select(parent(F.col("path")).alias("root"))
    crate = rs.filter(F.col("spec").startswith("crate::")).join(links.nearest_ancestor(rs.select(F.col("source").alias("path")).distinct(), roots).withColumnRenamed("path", "source"), "source")
    segments = F.split(F.regexp_replace(F.regexp_replace("spec", r"^crate::", ""), r"(::)?\{.*$|\s+as\s.*$", ""), "::")
    deep = crate.select("source", "root", "spec", segments.alias("s")).select("source", "root", "spec", "s", F.explode(F.sequence(F.size("s"), F.lit(1), F.lit(-1))).alias("n"))
    base = joined_path(F.col("root"), F.concat(F.lit("src/"), F.array_join(F.slice("s", 1, F.col("n")), "/")))
    hit = links.first_candidate(deep.select("source", "spec", "n", base.alias("base")), F.col("base"), [".rs", "/mod.rs"], files)
    out = out.union(hit.groupBy("source", "spec").agg(F.max_by("target", "n").alias("target")).select("source", "target"))
    return _link(out.filter("source != target"), "imports", "parser")


def notebook_uses(imports: DataFrame, files: DataFrame) -> DataFrame:
    """R5: notebooks to the modules of the tree that they import by absolute name."""
    rows = imports.filter((ext(F.col("path")) == "ipynb") & F.col("spec").rlike(r"^[^.]")).select(F.col("path").alias("source"), F.replace("spec", F.lit("."), F.lit("/")).alias("base"))
    return _link(links.first_candidate(rows, F.col("base"), [".py", "/__init__.py"], files).select("source", "target"), "uses", "suggested", "probable")


def mentioned(docstrings: DataFrame, symbols: DataFrame) -> DataFrame:
    """R3: words of docstrings (path, text) that look like identifiers and name a symbol of exactly one other file."""
    words = docstrings.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), F.lit(1))).alias("token")).filter(looks_like_identifier(F.col("token")))
    names = symbols.filter(F.col("node_type").isin(CODE_KINDS)).select(F.col("path").alias("target"), F.substring_index("id", ".", -1).alias("token"))
    found = links.unique_matches(words, names, "source", "target").filter("source != target")
    return _link(found, "mentions", "suggested", "probable")


def cochanged(commits: DataFrame, least: int = 5) -> DataFrame:
    """R4: files that change together."""
    return _link(links.cochanged(commits, least).select(F.col("a").alias("source"), F.col("b").alias("target")), "co_changed", "suggested", "heuristic")


ROLE = r":(?:py:)?(?:class|func|meth|attr|mod|exc|data|obj):`(?:[^`<]*<)?[~!]?([\w.]+)(?:\(\))?>?`"


def roles(content: DataFrame, symbols: DataFrame) -> DataFrame:
    """R6: documentation roles whose last name part is a symbol of exactly one file."""
    docs = content.filter(ext(F.col("path")).isin("rst", "txt", "md", "py"))
    said = docs.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(ROLE), F.lit(1))).alias("name")).select("source", F.substring_index("name", ".", -1).alias("token"))
    names = symbols.filter(F.col("node_type").isin(CODE_KINDS)).select(F.col("path").alias("target"), F.substring_index("id", ".", -1).alias("token"))
    return _link(links.unique_matches(said, names, "source", "target").filter("source != target"), "describes", "extracted")


TERM = re.compile(r'"([^"]*)"|(\S+)')


def query_filter(query: str) -> tuple[Column, list[str]]:
    """(condition on a file table, remaining terms) of a query: ``*.py``, ``ext:``, ``path:``, ``modified:7d``, quoted phrases."""
    where, rest = F.lit(True), []
    for phrase, word in TERM.findall(query):
        key, _, value = word.partition(":")
        if phrase:
            rest.append(phrase)
        elif key == "ext" and value:
            where = where & (F.col("ext") == value.lower().lstrip("."))
        elif key == "path" and value:
            where = where & F.col("path").contains(value)
        elif key == "modified" and re.fullmatch(r"\d+[hdw]", value):
            hours = int(value[:-1]) * {"h": 1, "d": 24, "w": 168}[value[-1]]
            where = where & (F.col("mtime_ns") >= F.unix_micros(F.current_timestamp()) * 1000 - F.lit(hours * 3600 * 10**9))
        elif word.startswith("*."):
            where = where & (F.col("ext") == word[2:].lower())
        else:
            rest.append(word)
    return where, rest
