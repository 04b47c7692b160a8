"""The engine's operators as named queries over the relational tables, with their SQL.

Mappings used throughout: a document is the file ``source/lang/doc_id.txt``, a page is
the file of its url without scheme, query and fragment, an order is a commit and its
parts are the commit's files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomgrid.functions import address, text
from fathomgrid.operators import fuzzy, graph, links, resolve, search
from fathomgrid.plans.registry import register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a file table; ``time`` is the page's number."""
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^?#]+)", 1).alias("path"), F.col("page_id").alias("time"))


PATHS = "paths AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]+)', 1) AS path, page_id AS time FROM pages)"
TOKENS = r"toks AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS term FROM documents)"
POSTINGS = TOKENS + ", post AS (SELECT term, doc_id, least(count(*), 255) AS tf FROM toks GROUP BY ALL)"
QUERY = ["the", "of", "erand", "tion", "la"]


@register("token_freq", f"WITH {POSTINGS} SELECT term, doc_id, CAST(tf AS INTEGER) AS tf FROM post")
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(read(spark, d, "documents"))


@register("doc_len", f"WITH {TOKENS} SELECT doc_id, count(*) AS doc_len FROM toks GROUP BY doc_id")
def doc_len(spark: SparkSession, d: str) -> DataFrame:
    return search.lengths(read(spark, d, "documents"))


@register("doc_freq", f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM toks GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(read(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"))


@register("corpus_stats", f"WITH {TOKENS}, l AS (SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id) SELECT count(*) AS docs, round(avg(n), 6) AS avg_len, CAST(sum(n) AS BIGINT) AS tokens FROM l")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.lengths(read(spark, d, "documents")).agg(F.count("*").alias("docs"), F.round(F.avg("doc_len"), 6).alias("avg_len"), F.sum("doc_len").alias("tokens"))


def _bm25_sql(query: list[str]) -> str:
    values = ", ".join(f"('{q}')" for q in query)
    return f"""WITH {POSTINGS}, q(term) AS (VALUES {values}), len AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY doc_id),
c AS (SELECT count(*) AS n, avg(dl) AS a FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id), c GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


def _bm25(spark: SparkSession, d: str, query: list[str]) -> DataFrame:
    scores = search.matched(read(spark, d, "documents"), query)
    return search.top(scores.select("doc_id", F.round("score", 6).alias("score")), 20, "doc_id")


@register("bm25_topk", _bm25_sql(QUERY))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, QUERY)


@register("bm25_repeat_term", _bm25_sql(["erand", "erand", "la"]))
def bm25_repeat_term(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, ["erand", "erand", "la"])


_VARINT = "1 + " + " + ".join(f"CASE WHEN gap >= {1 << (7 * i)} THEN 1 ELSE 0 END" for i in range(1, 9))


@register("index_size_stats", f"WITH {POSTINGS}, g AS (SELECT term, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post) SELECT count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum({_VARINT}) AS BIGINT) AS gap_bytes FROM g")
def index_size_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.index_size(search.postings(read(spark, d, "documents")))


@register("top_term_cut", f"WITH {POSTINGS}, t AS (SELECT term, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM post GROUP BY term), a AS (SELECT sum(c) AS total FROM t), k(cut) AS (VALUES (10::BIGINT), (100), (1000)) SELECT cut, CAST(sum(c) AS BIGINT) AS removed, round(sum(c) / any_value(total), 6) AS share FROM k JOIN t ON r <= cut, a GROUP BY cut")
def top_term_cut(spark: SparkSession, d: str) -> DataFrame:
    return search.top_term_cut(search.postings(read(spark, d, "documents")), (10, 100, 1000))


@register("fuzzy_candidates", f"WITH {PATHS} SELECT path FROM paths WHERE regexp_matches(lower(split_part(path, '/', -1)), '1.*?2')")
def fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path").filter(fuzzy.has_subsequence(F.substring_index("path", "/", -1), "12"))


@register("fuzzy_candidates_fullpath", f"WITH {PATHS} SELECT path FROM paths WHERE regexp_matches(lower(path), 't.*?h.*?/.*?e.*?n')")
def fuzzy_candidates_fullpath(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path").filter(fuzzy.has_subsequence(F.col("path"), "th/en"))


def _fuzzy_sql(needle: str, k: int) -> str:
    """The alignment score as a walk over the columns of each path's span, all characters of the needle in lists."""
    lazy = "".join(".*?" + c for c in needle)
    back = ".*?".join(reversed(needle))
    each = f"range(1, {len(needle) + 1})"
    return f"""WITH RECURSIVE {PATHS}, low AS (SELECT page_id, path, lower(path) AS low, regexp_extract(lower(path), '^{lazy}') AS head FROM paths WHERE regexp_matches(lower(path), '{lazy}')),
cand AS (SELECT page_id, path, low, length(head) AS stop, length(head) - length(regexp_extract(reverse(head), '^{back}')) AS begin, length(path) - length(split_part(path, '/', -1)) AS name_at FROM low),
w(page_id, path, low, stop, h, name_at, s, gap, met, best) AS (
  SELECT page_id, path, low, stop, begin + 1, name_at, list_transform({each}, lambda i: -1000000), list_transform({each}, lambda i: false), list_transform({each}, lambda i: false), -1000000 FROM cand
  UNION ALL SELECT page_id, path, low, stop, h + 1, name_at, list_transform({each}, lambda i: greatest(hit[i], skip[i])), list_transform({each}, lambda i: hit[i] < skip[i]),
    list_transform({each}, lambda i: hit[i] >= skip[i] AND hit[i] > -500000), greatest(best, hit[{len(needle)}], skip[{len(needle)}])
  FROM (SELECT *, list_transform({each}, lambda i: s[i] - CASE WHEN gap[i] THEN 1 ELSE 3 END) AS skip,
    list_transform({each}, lambda i: CASE WHEN low[h] <> '{needle}'[i] THEN -1000000 ELSE CASE WHEN i = 1 THEN 0 ELSE s[i - 1] END + CASE WHEN i > 1 AND met[i - 1] THEN 8 ELSE 0 END + bonus END) AS hit
    FROM (SELECT *, 16 + CASE WHEN h = 1 OR contains('/_-. ' || chr(92), path[h - 1]) THEN 8 WHEN path[h] BETWEEN 'A' AND 'Z' AND path[h - 1] BETWEEN 'a' AND 'z' THEN 7 ELSE 0 END + CASE WHEN h > name_at THEN 4 ELSE 0 END AS bonus FROM w WHERE h <= stop)))
SELECT path, CAST(max(best) - length(path) // 16 AS INTEGER) AS score FROM w GROUP BY page_id, path ORDER BY score DESC, path LIMIT {k}"""


@register("fuzzy_topk", _fuzzy_sql("th/en1", 20))
def fuzzy_topk(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.ranked(files(spark, d), "th/en1", 20)


_TAGGED = "tagged AS (SELECT event_id, 'see #' || event_type || '/' || (user_id % 10) || ' not x#' || event_id AS t FROM events)"
_TAGS = _TAGGED + r", found AS (SELECT event_id, list_sort(list_distinct(list_transform(regexp_extract_all(t, '(^|[^A-Za-z0-9_])#[A-Za-z0-9_/\-]+'), lambda x: regexp_replace(x, '^[^#]*#', '')))) AS tags FROM tagged)"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat(F.lit("see #"), "event_type", F.lit("/"), (F.col("user_id") % 10).cast("string"), F.lit(" not x#"), F.col("event_id").cast("string"))
    return read(spark, d, "events").select("event_id", text.tags(note).alias("tags"))


@register("tags_by_doc", f"WITH {_TAGS} SELECT event_id, array_to_string(tags, ',') AS tags FROM found")
def tags_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("event_id", F.array_join("tags", ",").alias("tags"))


@register("tag_index", f"WITH {_TAGS}, e AS (SELECT event_id, unnest(tags) AS tag FROM found) SELECT tag, count(*) AS n, min(event_id) AS first_id, CAST(sum(event_id) AS BIGINT) AS id_sum FROM e GROUP BY tag")
def tag_index(spark: SparkSession, d: str) -> DataFrame:
    each = _tagged(spark, d).select("event_id", F.explode("tags").alias("tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum("event_id").alias("id_sum"))


_TITLES = "titles AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages)"
_SLUG = r"CASE WHEN s = '' THEN 'section' ELSE s END"
_SLUGS = _TITLES + r", s0 AS (SELECT page_id, regexp_replace(trim(lower(title)), '\s+', '-', 'g') AS s FROM titles), s1 AS (SELECT page_id, regexp_replace(s, '[^\p{L}\p{N}\-_]', '', 'g') AS s FROM s0), s2 AS (SELECT page_id, regexp_replace(regexp_replace(s, '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM s1), slugs AS (SELECT page_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM s2)"


def _slugs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.slug(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("slug"))


@register("slug", f"WITH {_SLUGS} SELECT page_id, slug FROM slugs")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return _slugs(spark, d)


@register("slug_dedup", f"WITH {_SLUGS}, n AS (SELECT page_id, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM slugs) SELECT page_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS id FROM n")
def slug_dedup(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("slug").orderBy("page_id"))
    return _slugs(spark, d).withColumn("n", n).select("page_id", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n").cast("string"))).alias("id"))


@register("address_encode", "SELECT p_partkey, 'vault://' || replace(p_brand, ' ', '_') || '#' || replace(replace(replace(replace(p_name || '/1.5%', '%', '%25'), '#', '%23'), '/', '%2F'), '.', '%2E') AS uri FROM part")
def address_encode(spark: SparkSession, d: str) -> DataFrame:
    name = address.encode(F.concat("p_name", F.lit("/1.5%")), symbol=True)
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit(address.SCHEME), F.replace("p_brand", F.lit(" "), F.lit("_")), F.lit("#"), name).alias("uri"))


_URIS = "u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'vault://' || path WHEN 1 THEN 'vault://' || path || '#h:top' WHEN 2 THEN 'vault://' || path || '#A.b' WHEN 3 THEN path WHEN 4 THEN 'vault:///' || path ELSE 'vault://' || path || '#' END AS uri FROM paths)"


def _uris(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.concat(F.lit(address.SCHEME), "path"), F.col("page_id") % 6
    uri = F.when(k == 0, p).when(k == 1, F.concat(p, F.lit("#h:top"))).when(k == 2, F.concat(p, F.lit("#A.b"))).when(k == 3, F.col("path")).when(k == 4, F.concat(F.lit("vault:///"), "path")).otherwise(F.concat(p, F.lit("#")))
    return files(spark, d).select("page_id", uri.alias("uri"))


@register("address_parse", f"""WITH {PATHS}, {_URIS}, r AS (SELECT page_id, uri, substr(uri, 9) AS rest FROM u),
x AS (SELECT page_id, uri, split_part(rest, '#', 1) AS path, CASE WHEN contains(rest, '#') THEN regexp_replace(rest, '^[^#]*#', '') END AS f FROM r)
SELECT page_id, path, CASE WHEN f IS NULL THEN 'file' WHEN starts_with(f, 'h:') THEN 'heading' ELSE 'symbol' END AS kind, regexp_replace(f, '^h:', '') AS value,
CASE WHEN NOT starts_with(uri, 'vault://') THEN 'MissingScheme' WHEN path = '' THEN 'EmptyPath' WHEN starts_with(path, '/') THEN 'AbsolutePath' WHEN f = '' THEN 'EmptyFragment' END AS error FROM x""")
def address_parse(spark: SparkSession, d: str) -> DataFrame:
    return _uris(spark, d).select("page_id", address.parse(F.col("uri")).alias("a")).select("page_id", "a.path", "a.kind", "a.value", "a.error")


_ODD = "CASE page_id % 5 WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN 'a/../' || path WHEN 3 THEN 'C:' || chr(92) || path ELSE '' END"


@register("path_normalize_errors", f"WITH {PATHS}, o AS (SELECT page_id, {_ODD} AS p FROM paths) SELECT page_id, replace(p, chr(92), '/') AS path, CASE WHEN p = '' THEN 'EmptyPath' WHEN starts_with(p, '/') OR p[2] = ':' THEN 'AbsolutePath' WHEN list_contains(string_split(replace(p, chr(92), '/'), '/'), '..') THEN 'ParentTraversal' END AS error FROM o")
def path_normalize_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 5
    odd = F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("/"), "path")).when(k == 2, F.concat(F.lit("a/../"), "path")).when(k == 3, F.concat(F.lit("C:\\"), "path")).otherwise("")
    return files(spark, d).select("page_id", odd.alias("p")).select("page_id", F.replace("p", F.lit("\\"), F.lit("/")).alias("path"), address.path_error(F.col("p")).alias("error"))


@register("symbol_search", "SELECT p_brand || '.' || p_name AS id, p_partkey FROM part WHERE contains(lower(p_brand || '.' || p_name), 'brand#1') ORDER BY p_partkey LIMIT 50")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "part").select(F.concat("p_brand", F.lit("."), "p_name").alias("id"), "p_partkey")
    return links.symbols_with(ids, "Brand#1").orderBy("p_partkey").limit(50)


@register("json_pointers", "SELECT event_id, '/' || replace(replace(k, '~', '~0'), '/', '~1') AS pointer, props ->> ('$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_pointers(spark: SparkSession, d: str) -> DataFrame:
    return links.json_pointers(read(spark, d, "events"), "event_id", "props")


@register("preview", "WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+', '') AS t FROM documents) SELECT doc_id, substr(t, 1, 200) || CASE WHEN length(t) > 200 THEN '…' ELSE '' END AS preview FROM t")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@register("line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents")
def line_range(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.line_range(F.col("text"), 2, 4).alias("lines"))


@register("byte_span", "SELECT doc_id, decode(substr(hex(encode(text)), 21, 0)::VARCHAR::BLOB) || substr(text, 1, 5) AS head FROM documents")
def byte_span(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("text", 1, 5)
    return read(spark, d, "documents").select("doc_id", text.byte_span(F.col("text"), F.lit(0), F.octet_length(first)).alias("head"))


@register("csv_header_columns", "SELECT p_partkey, pos, trim(trim(name), '\"') AS name FROM (SELECT p_partkey, unnest(string_split(h, ',')) AS name, generate_subscripts(string_split(h, ','), 1) - 1 AS pos FROM (SELECT p_partkey, '\"' || p_brand || '\", ' || p_type || ',,size' AS h FROM part)) WHERE trim(trim(name), '\"') <> ''")
def csv_header_columns(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit('"'), "p_brand", F.lit('", '), "p_type", F.lit(",,size"))
    return links.csv_columns(read(spark, d, "part").select("p_partkey", header.alias("line")), "p_partkey")


_PREFIX = "pre AS (SELECT path, time, unnest(list_concat([''], list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) AS id FROM paths)"
_NODES = f"WITH {PATHS}, {_PREFIX}, n AS (SELECT id, CASE WHEN bool_or(id = path) THEN 'file' ELSE 'folder' END AS kind, min(time) AS time FROM pre GROUP BY id)"
_EDGES = f"{PATHS}, {_PREFIX}, edges AS (SELECT DISTINCT CASE WHEN contains(id, '/') THEN regexp_extract(id, '^(.*)/[^/]*$', 1) ELSE '' END AS source, id AS target, 'contains' AS rel FROM pre WHERE id <> '')"


@register("containment_nodes", _NODES + " SELECT id, split_part(id, '/', -1) AS label, kind, CASE WHEN kind = 'file' AND contains(split_part(id, '/', -1), '.') THEN lower(split_part(split_part(id, '/', -1), '.', -1)) ELSE '' END AS ext FROM n")
def containment_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(files(spark, d))


@register("containment_edges", f"WITH {_EDGES} SELECT * FROM edges")
def containment_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.contains(files(spark, d))


@register("folder_time", _NODES + " SELECT id, time FROM n WHERE kind = 'folder'")
def folder_time(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(files(spark, d), "time").filter("kind = 'folder'").select("id", "time")


@register("ext_histogram", f"WITH {PATHS} SELECT CASE WHEN contains(split_part(path, '/', -1), '.') THEN lower(split_part(path, '.', -1)) ELSE '' END AS ext, count(*) AS n FROM paths GROUP BY 1")
def ext_histogram(spark: SparkSession, d: str) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return files(spark, d).groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))


@register("node_degree", f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(graph.contains(files(spark, d)))


@register("visible_graph_topn", f"WITH {_EDGES}, deg AS (SELECT id FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY count(*) DESC, id LIMIT 40) SELECT * FROM edges WHERE source IN (SELECT id FROM deg) AND target IN (SELECT id FROM deg)")
def visible_graph_topn(spark: SparkSession, d: str) -> DataFrame:
    return graph.visible(graph.contains(files(spark, d)), 40)


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """order -> customer -> nation -> region as links."""
    e = lambda df, a, x, b, y, rel: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"), F.lit(rel).alias("rel"))
    return e(read(spark, d, "orders"), "o", "o_orderkey", "c", "o_custkey", "uses").union(e(read(spark, d, "customer"), "c", "c_custkey", "n", "c_nationkey", "references")).union(e(read(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey", "contains"))


_TRADE = "edges AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target, 'uses' AS rel FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'references' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'contains' FROM nation)"


@register("neighbors_hint", f"WITH {_TRADE} SELECT source AS id, 'out' AS direction, rel, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT target, 'in', rel, count(*) FROM edges GROUP BY ALL")
def neighbors_hint(spark: SparkSession, d: str) -> DataFrame:
    return graph.hints(_trade(spark, d))


def _bfs(depth: int) -> str:
    return f"""WITH RECURSIVE {_TRADE}, steps AS (SELECT source AS a, target AS id FROM edges UNION SELECT target, source FROM edges),
walk(id, depth) AS (SELECT 'n3', 0 UNION SELECT steps.id, depth + 1 FROM walk JOIN steps ON steps.a = walk.id WHERE depth < {depth})
SELECT id, min(depth) AS depth FROM walk WHERE id <> 'n3' GROUP BY id"""


def _register_bfs(depth: int) -> None:
    @register(f"neighbors_bfs_depth{depth}", _bfs(depth))
    def bfs(spark: SparkSession, d: str) -> DataFrame:
        return graph.neighbors(_trade(spark, d), ["n3"], depth)


for _depth in (1, 2, 3):
    _register_bfs(_depth)


@register("rename_closure", """WITH RECURSIVE e AS (SELECT s_suppkey AS seq, 'f' || s_suppkey AS old, 'f' || (s_suppkey + 3) AS new, 'k' || s_suppkey AS c FROM supplier WHERE s_suppkey % 5 <> 0),
w(source, target, c, hops) AS (SELECT old, new, c, 1 FROM e UNION ALL SELECT source, e.new, e.c, hops + 1 FROM w JOIN e ON e.old = w.target WHERE hops < 64)
SELECT source, arg_max(target, hops) AS target, arg_max(c, hops) AS commit, CAST(max(hops) AS INTEGER) AS hops FROM w GROUP BY source""")
def rename_closure(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = lambda k, p="f": F.concat(F.lit(p), k.cast("string"))
    events = read(spark, d, "supplier").filter(key % 5 != 0).select(key.alias("seq"), name(key).alias("old"), name(key + 3).alias("new"), name(key, "k").alias("commit"))
    return graph.rename_closure(events)


_SNAP = "cut AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS cut FROM events), old AS (SELECT 'u' || user_id AS path, count(*) AS size FROM events, cut WHERE ts < cut GROUP BY 1), new AS (SELECT 'u' || user_id AS path, count(*) AS size FROM events WHERE user_id % 7 <> 0 GROUP BY 1)"
_CHANGE = "CASE WHEN old.path IS NULL THEN 'Added' WHEN new.path IS NULL THEN 'Removed' ELSE 'Modified' END"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = read(spark, d, "events")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")
    cut = ev.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("cut"))
    old = ev.crossJoin(F.broadcast(cut)).filter("ts < cut").groupBy(path).agg(F.count("*").alias("size"))  # cut is one row
    return old, ev.filter("user_id % 7 <> 0").groupBy(path).agg(F.count("*").alias("size"))


@register("snapshot_diff", f"WITH {_SNAP} SELECT coalesce(old.path, new.path) AS path, {_CHANGE} AS change FROM old FULL JOIN new ON old.path = new.path WHERE old.path IS NULL OR new.path IS NULL OR old.size <> new.size")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return links.snapshot_diff(*_snapshots(spark, d), ["size"])


@register("watch_batch_kind", f"WITH {_SNAP}, b AS (SELECT DISTINCT 'u' || user_id AS path FROM events) SELECT b.path, CASE WHEN new.path IS NOT NULL AND old.path IS NOT NULL THEN 'Modified' WHEN new.path IS NOT NULL THEN 'Added' ELSE 'Removed' END AS change FROM b LEFT JOIN old USING (path) LEFT JOIN new USING (path) WHERE old.path IS NOT NULL OR new.path IS NOT NULL")
def watch_batch_kind(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    batch = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"))
    return links.batch_changes(batch, exists=new, known=old)


@register("debounce_batches", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, b""")
def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    return links.debounced(read(spark, d, "events"), "user_id", "ts", "12 hours")


_VOCAB = r"vocab AS (SELECT token, min(item_id) AS item_id, count(DISTINCT item_id) AS files FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS token FROM benchmark) GROUP BY token)"
_MENTION = r"said AS (SELECT conv_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS token FROM conversations)"
_UNIQUE = _VOCAB + ", " + _MENTION + ", m AS (SELECT conv_id, item_id, token, count(*) AS mentions FROM said JOIN vocab USING (token) WHERE files = 1 GROUP BY ALL)"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    vocab = read(spark, d, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    said = read(spark, d, "conversations").select("conv_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    return links.unique_matches(said, vocab, "conv_id", "item_id")


@register("unique_name_match", f"WITH {_UNIQUE} SELECT * FROM m")
def unique_name_match(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d)


_RANKED = ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, item_id ORDER BY mentions DESC, token) AS n FROM m), best AS (SELECT conv_id, item_id, token, mentions FROM r WHERE n = 1)"


@register("r1_ranked", f"WITH {_UNIQUE}{_RANKED} SELECT * FROM best ORDER BY octet_length(encode(token)) DESC, mentions DESC, conv_id, item_id LIMIT 50")
def r1_ranked(spark: SparkSession, d: str) -> DataFrame:
    best = links.best_token(_mentions(spark, d), "conv_id", "item_id")
    return best.orderBy(F.octet_length("token").desc(), F.desc("mentions"), "conv_id", "item_id").limit(50)


_KEY = "substr(sha256('R1' || chr(10) || conv_id || chr(10) || item_id), 1, 16)"


@register("undecided", f"WITH {_UNIQUE}{_RANKED}, keyed AS (SELECT *, {_KEY} AS key FROM best) SELECT conv_id, item_id, key FROM keyed WHERE key NOT IN (SELECT substr(sha256('R1' || chr(10) || doc_id || chr(10) || (doc_id % 40)), 1, 16) FROM labels WHERE quality = 1)")
def undecided(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    best = links.best_token(_mentions(spark, d), "conv_id", "item_id").select("conv_id", "item_id", text.decision_key(F.lit("R1"), s("conv_id"), s("item_id")).alias("key"))
    decided = read(spark, d, "labels").filter("quality = 1").select(text.decision_key(F.lit("R1"), s("doc_id"), (F.col("doc_id") % 40).cast("string")).alias("key"))
    return best.join(decided, "key", "left_anti").select("conv_id", "item_id", "key")


@register("cochange_pairs", """WITH f AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem), ok AS (SELECT c FROM f GROUP BY c HAVING count(*) BETWEEN 2 AND 12), g AS (SELECT * FROM f SEMI JOIN ok USING (c))
SELECT a.p AS a, b.p AS b, count(*) AS n FROM g a JOIN g b ON a.c = b.c AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2""")
def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    commits = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))
    return links.cochanged(commits, least=2)


@register("config_path_refs", f"""WITH {PATHS}, h AS (SELECT path AS source, 'm.' || regexp_extract(path, '^([^/]*)', 1) || '/' || unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS value FROM pages JOIN paths USING (page_id) UNION ALL SELECT a.path, b.path FROM paths a JOIN paths b ON b.page_id = a.page_id + a.page_id % 3 UNION ALL SELECT path, '/abs/' || path FROM paths)
SELECT DISTINCT source, value AS target FROM h WHERE value IN (SELECT path FROM paths) AND value <> source AND NOT starts_with(value, '/')""")
def config_path_refs(spark: SparkSession, d: str) -> DataFrame:
    pages = files(spark, d)
    html = read(spark, d, "pages").join(pages, "page_id")
    href = html.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("x")).select("source", F.concat(F.lit("m."), F.regexp_extract("source", "^([^/]*)", 1), F.lit("/"), "x").alias("value"))
    near = pages.select(F.col("path").alias("source"), (F.col("page_id") + F.col("page_id") % 3).alias("page_id")).join(pages.select("page_id", F.col("path").alias("value")), "page_id").select("source", "value")
    absolute = pages.select(F.col("path").alias("source"), F.concat(F.lit("/abs/"), "path").alias("value"))
    return links.path_references(href.union(near).union(absolute), pages.select("path"))


@register("import_first_candidate", f"""WITH {PATHS}, s AS (SELECT path AS source, regexp_replace(path, '(\\.html|/)$', '') AS spec FROM paths),
c AS (SELECT source, unnest([spec, spec || '.html', spec || '/', spec || '/index.ts']) AS candidate, unnest([0, 1, 2, 3]) AS pos FROM s)
SELECT source, arg_min(candidate, pos) AS target FROM c JOIN paths ON candidate = path GROUP BY source""")
def import_first_candidate(spark: SparkSession, d: str) -> DataFrame:
    specs = files(spark, d).select(F.col("path").alias("source"), F.regexp_replace("path", r"(\.html|/)$", "").alias("spec"))
    found = links.first_candidate(specs, F.col("spec"), ["", ".html", "/", "/index.ts"], files(spark, d).select("path"))
    return found.select("source", "target")


@register("nearest_ancestor", f"""WITH {PATHS}, {_PREFIX}, roots AS (SELECT DISTINCT id AS root FROM pre WHERE id <> path AND length(id) % 2 = 0),
SELECT_ AS (SELECT path, id, length(id) AS depth FROM pre WHERE id <> path)
SELECT path, arg_max(id, depth) AS root FROM SELECT_ JOIN roots ON root = id GROUP BY path""")
def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    roots = f.select("path", F.explode(graph.prefixes(F.col("path"))).alias("root")).filter((F.col("root") != F.col("path")) & (F.length("root") % 2 == 0)).select("root").distinct()
    return links.nearest_ancestor(f.select("path"), roots)


@register("call_edge_ambiguity", f"WITH {_VOCAB}, {_MENTION} SELECT CASE WHEN files IS NULL THEN 'EXTERN' WHEN files = 1 THEN 'UNIQUE' ELSE 'AMBIG' END AS category, count(*) AS n FROM said LEFT JOIN vocab USING (token) GROUP BY 1")
def call_edge_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    vocab = read(spark, d, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("defs"))
    said = read(spark, d, "conversations").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return links.call_categories(said, vocab).groupBy("category").agg(F.count("*").alias("n"))


_LADDER = """old AS (SELECT p_partkey, p_brand || '/' || p_partkey || '.' || lower(p_type[1:3]) AS path, p_name AS sym FROM part),
now AS (SELECT CASE WHEN p_partkey % 10 = 1 THEN 'moved/' || p_partkey ELSE p_brand || '/' || p_partkey || '.' || lower(p_type[1:3]) END AS path, CASE WHEN p_partkey % 13 = 0 THEN p_name || ' x' ELSE p_name END AS sym FROM part WHERE p_partkey % 11 <> 0),
alias AS (SELECT p_brand || '/' || p_partkey || '.' || lower(p_type[1:3]) AS source, 'moved/' || p_partkey AS target FROM part WHERE p_partkey % 20 = 1),
base AS (SELECT split_part(path, '/', -1) AS b, count(*) AS n FROM now GROUP BY 1)"""


def _ladder(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = read(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    path = F.concat("p_brand", F.lit("/"), key, F.lit("."), F.lower(F.substring("p_type", 1, 3)))
    moved = F.concat(F.lit("moved/"), key)
    old = part.select("p_partkey", path.alias("path"), F.col("p_name").alias("sym"))
    now = part.filter("p_partkey % 11 <> 0").select(F.when(F.col("p_partkey") % 10 == 1, moved).otherwise(path).alias("path"), F.when(F.col("p_partkey") % 13 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")).alias("sym"))
    return old, now, part.filter("p_partkey % 20 = 1").select(path.alias("source"), moved.alias("target"))


@register("file_ladder", f"""WITH {_LADDER} SELECT p_partkey, CASE WHEN n0.path IS NOT NULL THEN 'F1' WHEN n2.path IS NOT NULL THEN 'F2' WHEN base.n = 1 THEN 'L3' WHEN base.n > 1 THEN 'L3a' ELSE 'BROKEN' END AS stage
FROM old LEFT JOIN (SELECT DISTINCT path FROM now) n0 ON n0.path = old.path LEFT JOIN alias ON source = old.path LEFT JOIN (SELECT DISTINCT path FROM now) n2 ON n2.path = alias.target LEFT JOIN base ON b = split_part(old.path, '/', -1)""")
def file_ladder(spark: SparkSession, d: str) -> DataFrame:
    old, now, alias = _ladder(spark, d)
    return resolve.file_ladder(old, now.select("path").distinct(), alias).select("p_partkey", "stage")


_SYMBOL = f"""WITH {_LADDER}, u AS (SELECT sym, count(DISTINCT path) AS n FROM now GROUP BY sym), s AS (SELECT DISTINCT path, sym FROM now), rows AS (SELECT p_partkey, old.path, CASE WHEN s1.path IS NOT NULL THEN 'S1' WHEN s2.path IS NOT NULL THEN 'S2' WHEN u.n = 1 THEN 'S3' WHEN u.n > 1 THEN 'S3a' ELSE 'GONE' END AS stage
FROM old LEFT JOIN s s1 ON s1.path = old.path AND s1.sym = old.sym LEFT JOIN alias ON source = old.path LEFT JOIN s s2 ON s2.path = alias.target AND s2.sym = old.sym LEFT JOIN u ON u.sym = old.sym)"""


@register("symbol_ladder_s1_s3", _SYMBOL + " SELECT p_partkey, stage FROM rows")
def symbol_ladder_s1_s3(spark: SparkSession, d: str) -> DataFrame:
    return resolve.symbol_ladder(*_ladder(spark, d)).select("p_partkey", "stage")


@register("recovery_rollup", _SYMBOL + " SELECT split_part(path, '/', 1) AS repo, split_part(path, '.', -1) AS lang, count(*) AS n, CAST(sum(CASE WHEN stage IN ('S1', 'S2', 'S3') THEN 1 ELSE 0 END) AS BIGINT) AS recovered FROM rows GROUP BY ROLLUP (split_part(path, '.', -1), split_part(path, '/', 1))")
def recovery_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve.symbol_ladder(*_ladder(spark, d)).select(F.substring_index("path", "/", 1).alias("repo"), F.substring_index("path", ".", -1).alias("lang"), "stage")
    return rows.rollup("lang", "repo").agg(F.count("*").alias("n"), F.sum(F.when(F.col("stage").isin("S1", "S2", "S3"), 1).otherwise(0)).cast("long").alias("recovered")).select("repo", "lang", "n", "recovered")


_SETS = r"sh AS (SELECT DISTINCT conv_id, turn, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda t: lower(t)) AS w FROM conversations)))"


@register("exact_jaccard", f"WITH {_SETS}, n AS (SELECT conv_id, turn, count(*) AS n FROM sh GROUP BY ALL), i AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, count(*) AS k FROM sh a JOIN sh b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.g = b.g GROUP BY ALL) SELECT i.conv_id, a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM i JOIN n x ON x.conv_id = i.conv_id AND x.turn = a JOIN n y ON y.conv_id = i.conv_id AND y.turn = b")
def exact_jaccard(spark: SparkSession, d: str) -> DataFrame:
    sets = read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(text.shingles(text.tokens(F.col("text")), 3)).alias("s"))
    return resolve.jaccard_within(sets, "conv_id", "turn")


@register("oplog_fold", """WITH log AS (SELECT o_custkey AS id, o_orderkey AS ts, CASE o_orderstatus WHEN 'F' THEN 'del' WHEN 'O' THEN 'add' ELSE 'retarget' END AS op, o_orderpriority AS target FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, op DESC) AS n FROM log) SELECT id, op, target, ts FROM r WHERE n = 1 AND op <> 'del'""")
def oplog_fold(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "F", "del").when(F.col("o_orderstatus") == "O", "add").otherwise("retarget")
    log = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ts"), op.alias("op"), F.col("o_orderpriority").alias("target"))
    return graph.fold(log).select("id", "op", "target", "ts")


@register("layer_union_dedup", """WITH h AS (SELECT p_brand AS uri, 0 AS layer, p_partkey AS rank FROM part UNION ALL SELECT p_type, 1, p_partkey FROM part UNION ALL SELECT p_brand, 2, p_partkey FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY layer, rank) AS n FROM h) SELECT uri, layer, rank FROM r WHERE n = 1 ORDER BY layer, rank LIMIT 40""")
def layer_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    layer = lambda c, n: part.select(F.col(c).alias("uri"), F.lit(n).alias("layer"), F.col("p_partkey").alias("rank"))
    return graph.first_rank(layer("p_brand", 0).union(layer("p_type", 1)).union(layer("p_brand", 2)), "uri", "layer", "rank").orderBy("layer", "rank").limit(40)
