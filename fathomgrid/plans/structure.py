"""Queries over the structure of documents and over address ladders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.functions import text
from fathomgrid.operators import documents, graph, resolve
from fathomgrid.plans.registry import register
from fathomgrid.plans.relational import _EDGES, _LADDER, PATHS, _ladder, files, read

_LINES = "lines AS (SELECT doc_id, pos, line, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return documents.lines(read(spark, d, "documents"), "doc_id").withColumn("pos", F.col("pos").cast("long"))


@register("line_offsets", f"WITH {_LINES} SELECT doc_id, pos, start, length(line) AS n FROM lines")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "pos", "start", F.length("line").cast("long").alias("n"))


@register("fence_parity", f"WITH {_LINES}, f AS (SELECT doc_id, pos, coalesce(sum(CASE WHEN length(line) % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM lines) SELECT * FROM f")
def fence_parity(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a length divisible by five stand for fences; the tables have none."""
    return documents.fenced(_lines(spark, d), "doc_id", F.length("line") % 5 == 0).select("doc_id", "pos", "inside")


@register("heading_sections", f"""WITH {_LINES}, h AS (SELECT doc_id, 1 + length(line) % 6 AS level, start FROM lines)
SELECT h.doc_id, CAST(h.level AS INTEGER) AS level, h.start, (SELECT min(x.start) FROM h x WHERE x.doc_id = h.doc_id AND x.start > h.start AND x.level <= h.level) AS "end" FROM h""")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every line is a heading whose level comes from its length."""
    heads = _lines(spark, d).select("doc_id", (F.length("line") % 6 + 1).cast("int").alias("level"), "start")
    return documents.sections(heads, "doc_id")


@register("dangling_references", f"WITH {PATHS}, r AS (SELECT DISTINCT path AS source, regexp_replace(path, '[0-9]$', '7') AS target FROM paths) SELECT source, target FROM r WHERE target NOT IN (SELECT path FROM paths)")
def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    refs = f.select(F.col("path").alias("source"), F.regexp_replace("path", "[0-9]$", "7").alias("target"))
    return documents.dangling(refs, f.select(F.col("path").alias("target")))


@register("timeline_reveal", f"WITH {_EDGES}, s AS (SELECT id FROM pre GROUP BY id HAVING min(time) <= 100) SELECT source, target, rel FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)")
def timeline_reveal(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return documents.revealed(graph.nodes(f, "time"), graph.contains(f), 100)[1]


@register("locality_share", "WITH p AS (SELECT 'a' || (l_partkey % 3) || '/' || l_partkey AS source, 'a' || (l_suppkey % 3) || '/' || l_suppkey AS target FROM lineitem) SELECT count(*) AS pairs, round(avg(CASE WHEN split_part(source, '/', 1) = split_part(target, '/', 1) THEN 1.0 ELSE 0.0 END), 6) AS share FROM p")
def locality_share(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.concat(F.lit("a"), (F.col(c) % 3).cast("string"), F.lit("/"), F.col(c).cast("string"))
    return documents.same_top_share(read(spark, d, "lineitem").select(at("l_partkey").alias("source"), at("l_suppkey").alias("target")))


@register("bulk_retarget", f"""WITH {_LADDER}, gone AS (SELECT path, split_part(path, '/', -1) AS name FROM old WHERE path NOT IN (SELECT path FROM now)),
uniq AS (SELECT replace(split_part(path, '/', -1), '.', '') AS junk, split_part(path, '/', -1) AS name, min(path) AS new FROM (SELECT 'new/' || path AS path FROM old) GROUP BY 1, 2 HAVING count(*) = 1)
SELECT '' AS old_prefix, 'new' AS new_prefix, count(*) AS n FROM gone JOIN uniq USING (name)""")
def bulk_retarget(spark: SparkSession, d: str) -> DataFrame:
    """All files move below ``new``: one rule mends all broken paths."""
    old, now, _ = _ladder(spark, d)
    broken = old.select("path").join(now.select("path"), "path", "left_anti")
    return documents.retarget_rules(broken, old.select(F.concat(F.lit("new/"), "path").alias("path")))


_POINTERS = "o AS (SELECT event_id, event_type || '.json' AS path, '/k' || (event_id % 50) AS ptr, 'k' || (event_id % 50) AS key FROM events), t AS (SELECT DISTINCT event_type || '.json' AS path, '/k' || (user_id % 20) AS ptr, 'k' || (user_id % 20) AS key FROM events WHERE user_id % 3 <> 0), u AS (SELECT key FROM (SELECT DISTINCT path, key FROM t) GROUP BY key HAVING count(*) = 1)"


@register("pointer_ladder", f"WITH {_POINTERS} SELECT o.event_id, CASE WHEN t.path IS NOT NULL THEN 'J1' WHEN u.key IS NOT NULL THEN 'J3' ELSE 'BROKEN' END AS stage FROM o LEFT JOIN t ON t.path = o.path AND t.ptr = o.ptr LEFT JOIN u ON u.key = o.key")
def pointer_ladder(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events")
    path = F.concat("event_type", F.lit(".json")).alias("path")
    key = lambda c, n: F.concat(F.lit("k"), (F.col(c) % n).cast("string"))
    old = ev.select("event_id", path, F.concat(F.lit("/"), key("event_id", 50)).alias("ptr"), key("event_id", 50).alias("key"))
    now = ev.filter("user_id % 3 <> 0").select(path, F.concat(F.lit("/"), key("user_id", 20)).alias("ptr"), key("user_id", 20).alias("key")).distinct()
    same = now.select("path", "ptr", F.concat("path", "ptr").alias("target"))
    unique = now.groupBy("key").agg(F.min(F.concat("path", "ptr")).alias("target"), F.count("*").alias("c")).filter("c = 1")
    return documents.staged(old, [("J1", same, ["path", "ptr"]), ("J3", unique, ["key"])], "BROKEN").select("event_id", "stage")


@register("length_percentiles", "SELECT source, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY source")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    at = lambda p: F.round(F.percentile("n_chars", F.lit(p)), 6)
    return read(spark, d, "documents").groupBy("source").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return "[" + ", ".join(out) + "]::BIGINT[]"


def _sketches_sql(name: str, source: str, k: int, size: int) -> str:
    """CTEs that end in ``name`` (id, v): the sketch of each row of ``source`` (id, text), not padded.  SQL has no CRC-32 of its own."""
    step = f"lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1])"
    octets = "list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)"
    return rf"""{name}_w AS (SELECT id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM {source}),
{name}_g AS (SELECT id, unnest(CASE WHEN len(w) < {k} THEN [text] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS g FROM {name}_w),
{name}_c AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT) AS h FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM {name}_g))),
{name} AS MATERIALIZED (SELECT id, list_slice(list_sort(list_distinct(list(h))), 1, {size}) AS v FROM {name}_g JOIN {name}_c USING (g) GROUP BY id)"""


def _matches_sql(name: str, left: str, right: str, k: int, size: int, threshold: float, others: bool) -> str:
    """CTEs that end in ``name`` (id, match, jaccard), like ``resolve.sketch_matches``."""
    grams = lambda t: rf"SELECT id, list_distinct(CASE WHEN len(w) < {k} THEN [] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS s FROM (SELECT id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w FROM {t})"
    one = f"{name}_l AS (SELECT * FROM {name}_r)" if left == right else _sketches_sql(name + "_l", left, k, size)
    return f"""{_sketches_sql(name + "_r", right, k, size)}, {one},
{name}_v AS (SELECT id AS match, unnest(v) AS h FROM {name}_r), {name}_q AS (SELECT h FROM {name}_v GROUP BY h HAVING count(*) <= 200),
{name}_p AS (SELECT id, match, count(*) AS votes FROM (SELECT id, unnest(v) AS h FROM {name}_l) JOIN {name}_v USING (h) SEMI JOIN {name}_q USING (h) {"WHERE id <> match" if others else ""} GROUP BY ALL),
{name}_f AS MATERIALIZED (SELECT id, match FROM {name}_p QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, match) <= 40),
{name}_x AS MATERIALIZED ({grams(left)}), {name}_y AS MATERIALIZED ({grams(right)}),
{name}_s AS (SELECT f.id, f.match, round(len(list_intersect(x.s, y.s)) / greatest(len(list_distinct(list_concat(x.s, y.s))), 1), 6) AS jaccard FROM {name}_f f JOIN {name}_x x ON x.id = f.id JOIN {name}_y y ON y.id = f.match),
{name} AS (SELECT * FROM {name}_s WHERE jaccard >= {threshold} QUALIFY row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, match) = 1)"""


_DOCS = "src AS (SELECT doc_id AS id, text FROM documents)"


@register("shingle_sketch", f"WITH {_DOCS}, {_sketches_sql('sk', 'src', 3, 32)} SELECT id AS doc_id, array_to_string(list_concat(v, list_transform(range(0, 32 - len(v)), lambda i: 4294967295::BIGINT)), ',') AS sketch FROM sk")
def shingle_sketch(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(text.sketch(F.col("text")).cast("array<string>"), ",").alias("sketch"))


@register("sketch_vote_match", f"WITH {_DOCS}, {_matches_sql('m', 'src', 'src', 3, 32, 0.4, True)} SELECT * FROM m")
def sketch_vote_match(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return resolve.sketch_matches(docs, docs, others=True)


def _sweep_sql() -> str:
    ctes, rows = [r"items AS (SELECT item_id AS id, text FROM benchmark), edited AS (SELECT id, regexp_replace(text, '^(\S+) \S+', '\1 edited') AS text FROM items)"], []
    for k in (3, 4):
        for size in (16, 32):
            ctes.append(_matches_sql(f"m{k}_{size}", "edited", "items", k, size, 0.3, False))
            rows += [f"SELECT CAST({k} AS INTEGER) AS k, CAST({size} AS INTEGER) AS size, CAST({least} AS DOUBLE) AS threshold, count(*) AS matched, CAST(coalesce(sum(CASE WHEN id = match THEN 1 ELSE 0 END), 0) AS BIGINT) AS \"right\" FROM m{k}_{size} WHERE jaccard >= {least}" for least in (0.3, 0.4, 0.6)]
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@register("sketch_sweep", _sweep_sql())
def sketch_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Matches at several shingle widths, sketch sizes and thresholds, of benchmark items among conversations and items."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    edited = items.select("id", F.regexp_replace("text", r"^(\S+) \S+", "$1 edited").alias("text"))
    out = None
    for k in (3, 4):
        for size in (16, 32):
            m = resolve.sketch_matches(edited, items, k=k, size=size, threshold=0.3)
            for least in (0.3, 0.4, 0.6):
                row = m.filter(F.col("jaccard") >= least).agg(F.count("*").alias("matched"), F.coalesce(F.sum((F.col("id") == F.col("match")).cast("long")), F.lit(0)).alias("right")).select(F.lit(k).alias("k"), F.lit(size).alias("size"), F.lit(least).alias("threshold"), "matched", "right")
                out = row if out is None else out.unionByName(row)
    return out
