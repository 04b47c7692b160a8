"""Queries over generated files: what parsers and link rules find, with SQL that knows where it was put.

Every part is a file of each format, written from a template.  ``⟦n|`` and ``|n⟧`` mark
where symbol n starts and ends, so that the SQL can state its place without parsing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.operators import graph, links, resolve, search, suggest
from fathomgrid.plans.registry import register
from fathomgrid.plans.relational import long, read
from fathomgrid.sources import parsers
from fathomgrid.streaming import changes

MARK = re.compile(r"⟦\d\||\|\d⟧")
#: By name: extension, template, symbols (id, kind, name) in order, raw imports.
FORMATS: dict[str, tuple[str, str, list[tuple[str, str, str]], list[str]]] = {
    "py": (
        "py", "import os, sys as system\nfrom .util import x\n\n\n⟦0|def run_{k}(a):\n    return ')'|0⟧\n\n\n⟦1|class Part{k}:\n    ⟦2|def load(self):\n        # def no(): pass\n        return 1|2⟧\n\n    ⟦3|async def save(self):\n        pass|3⟧|1⟧\n",
        [("run_{k}", "function", "run_{k}"), ("Part{k}", "class", "Part{k}"), ("Part{k}.load", "method", "load"), ("Part{k}.save", "method", "save")], ["os", "sys", ".util"],
    ),
    "py_edit": ("py", "⟦0|def run_{k}():\n    x = 'open|0⟧\n\n⟦1|def half_{k}(|1⟧", [("run_{k}", "function", "run_{k}"), ("half_{k}", "function", "half_{k}")], []),
    "go": (
        "go", 'package main\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\n\n⟦0|type Part{k} struct {\n\tN int\n}|0⟧\n\n⟦1|func (p *Part{k}) Load() {\n\tif true {\n\t}\n}|1⟧\n\n// func No() {}\n⟦2|func Run{k}() {}|2⟧\n',
        [("Part{k}", "struct", "Part{k}"), ("Part{k}.Load", "method", "Load"), ("Run{k}", "function", "Run{k}")], ["fmt", "net/http"],
    ),
    "rs": (
        "rs", "use crate::util::x;\nmod other;\n\n⟦0|struct Part{k} {\n    n: u8,\n}|0⟧\n\nimpl Part{k} {\n    ⟦1|fn load(&self) -> u8 {\n        self.n\n    }|1⟧\n}\n\nmod tests {\n    ⟦2|fn check_{k}() {}|2⟧\n}\n",
        [("Part{k}", "struct", "Part{k}"), ("Part{k}.load", "method", "load"), ("tests.check_{k}", "function", "check_{k}")], ["crate::util::x", "mod:other"],
    ),
    "ts": (
        "ts", 'import { a } from "./a{k}";\nconst r = require("left");\n\n⟦0|class Part{k} {\n  ⟦1|load(): void {\n    run();\n  }|1⟧\n}|0⟧\n\nexport ⟦2|interface Shape{k} {\n  x: number;\n}|2⟧\n\n⟦3|function go{k}() {\n}|3⟧\n',
        [("Part{k}", "class", "Part{k}"), ("Part{k}.load", "method", "load"), ("Shape{k}", "interface", "Shape{k}"), ("go{k}", "function", "go{k}")], ["./a{k}", "left"],
    ),
    "md": (
        "md", "⟦0|# Part {k}\n\ntext\n\n⟦1|## Setup\n\n```\n# no heading\n```\n|1⟧⟦2|## Setup ##\nmore\n|2⟧|0⟧⟦3|  # Next\n   ~~~\n# fenced\n   ~~~\n# \n|3⟧",
        [("part-{k}", "heading", "Part {k}"), ("setup", "heading", "Setup"), ("setup-2", "heading", "Setup"), ("next", "heading", "Next")], [],
    ),
    "rst": ("rst", "⟦0|Part {k}\n=================\n|0⟧\ntext\n\n⟦1|Setup\n-----\n|1⟧\nShort title here\n---\n", [("part-{k}", "heading", "Part {k}"), ("setup", "heading", "Setup")], []),
    "json": (
        "json", '⟦0|⟦1|⟦2|⟦3|⟦4|⟦5|⟦6|{"router": {"threshold": {k}, "on": true}, "tags": ["a", null], "a/b": "x"}|0⟧|1⟧|2⟧|3⟧|4⟧|5⟧|6⟧',
        [("/a~1b", "string", "a/b"), ("/router", "object", "router"), ("/router/on", "boolean", "on"), ("/router/threshold", "number", "threshold"), ("/tags", "array", "tags"), ("/tags/0", "string", "0"), ("/tags/1", "null", "1")], [],
    ),
    "yaml": (
        "yaml", "⟦0|⟦1|⟦2|⟦3|⟦4|⟦5|router:\n  threshold: {k}\n  live: yes\ntags:\n- a\n- 1.5\n|0⟧|1⟧|2⟧|3⟧|4⟧|5⟧",
        [("/router", "mapping", "router"), ("/router/threshold", "number", "threshold"), ("/router/live", "boolean", "live"), ("/tags", "sequence", "tags"), ("/tags/0", "string", "0"), ("/tags/1", "number", "1")], [],
    ),
    "toml": (
        "toml", '⟦0|⟦1|⟦2|⟦3|⟦4|⟦5|name = "p{k}"\n[router]\nthreshold = {k}\nlist = [1, "x"]\n|0⟧|1⟧|2⟧|3⟧|4⟧|5⟧',
        [("/name", "string", "name"), ("/router", "table", "router"), ("/router/list", "array", "list"), ("/router/list/0", "number", "0"), ("/router/list/1", "string", "1"), ("/router/threshold", "number", "threshold")], [],
    ),
    "csv": ("csv", '⟦0|⟦1|⟦2|⟦3|id,"name", score ,,n{k}|0⟧|1⟧|2⟧|3⟧\n1,2,3\n', [("id", "column", "id"), ("name", "column", "name"), ("score", "column", "score"), ("n{k}", "column", "n{k}")], []),
    "ipynb": (
        "ipynb", '{"cells": [{"cell_type": "code", "source": ["import a.b{k}\\ndef run_{k}():\\n", "    pass"]}, {"cell_type": "markdown", "source": "# Notes {k}"}]}',
        [("run_{k}", "function", "run_{k}"), ("notes-{k}", "heading", "Notes {k}")], ["a.b{k}"],
    ),
}
#: Symbols of notebooks are placed in the joined cells: what stands before them, and up to their end.
CELLS = [("import a.b{k}\n", "import a.b{k}\ndef run_{k}():\n    pass"), ("", "# Notes {k}")]


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """The keys of parts, dealt over as many tasks as a shuffle has: their file is small, what is parsed of it is not."""
    return read(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _content(spark: SparkSession, d: str, name: str) -> DataFrame:
    ext, marked, _, _ = FORMATS[name]
    key = F.col("p_partkey").cast("string")
    return _parts(spark, d).select(F.concat(F.lit(f"{name}/"), key, F.lit(f".{ext}")).alias("path"), F.replace(F.lit(MARK.sub("", marked)), F.lit("{k}"), key).alias("text"))


def _sql(template: str) -> str:
    """A template as an SQL expression over p_partkey."""
    quoted = template.replace("'", "''")
    return f"replace('{quoted}', '{{k}}', CAST(p_partkey AS VARCHAR))"


def _symbols_sql(name: str) -> str:
    ext, marked, found, _ = FORMATS[name]
    rows = []
    for i, (ident, kind, title) in enumerate(found):
        start, end = CELLS[i] if name == "ipynb" else (MARK.sub("", marked[: marked.index(f"⟦{i}|")]), MARK.sub("", marked[: marked.index(f"|{i}⟧")]))
        rows.append(f"SELECT {_sql(name + '/{k}.' + ext)} AS path, CAST({i} AS INTEGER) AS seq, {_sql(ident)} AS id, '{kind}' AS node_type, {_sql(title)} AS name, length({_sql(start)}) AS start_byte, length({_sql(end)}) AS end_byte FROM part")
    return " UNION ALL ".join(rows)


def _register_format(name: str) -> None:
    @register(f"symbols_{name}", _symbols_sql(name))
    def symbols_of(spark: SparkSession, d: str) -> DataFrame:
        out = parsers.symbols(_content(spark, d, name))
        return out.select("path", "seq", "id", "node_type", "name", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


for _name in FORMATS:
    _register_format(_name)


@register("raw_imports", " UNION ALL ".join(f"SELECT {_sql(n + '/{k}.' + x[0])} AS path, CAST({i} AS INTEGER) AS seq, {_sql(spec)} AS spec FROM part" for n, x in FORMATS.items() for i, spec in enumerate(x[3])))
def raw_imports(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, x in FORMATS.items():
        if x[3]:
            one = parsers.imports(_content(spark, d, name))
            out = one if out is None else out.union(one)
    return out


def _keyed(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    """Parts with columns given as SQL over the key k."""
    return _parts(spark, d).select(F.col("p_partkey").alias("k")).selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


_K = "p AS (SELECT p_partkey AS k FROM part)"


@register("resolved_imports", f"""WITH {_K}, f AS (SELECT 'src/m' || (k % 90) || '/a' || k || '.ts' AS path FROM p UNION SELECT 'src/lib/index.ts' UNION SELECT 'py/u' || k || '.py' FROM p WHERE k % 2 = 0 UNION SELECT 'py/pkg' || k || '/__init__.py' FROM p WHERE k % 2 = 1
UNION SELECT 'crate/src/w' || k || '.rs' FROM p WHERE k % 3 = 0 UNION SELECT 'crate/src/w' || k || '/mod.rs' FROM p WHERE k % 3 = 1 UNION SELECT 'crate/Cargo.toml'),
t AS (SELECT 'src/m' || (k % 90) || '/x' || k || '.ts' AS source, 'src/m' || ((k + 1) % 90) || '/a' || (k + 1) || '.ts' AS target FROM p UNION SELECT 'src/m' || (k % 90) || '/x' || k || '.ts', 'src/lib/index.ts' FROM p
UNION SELECT 'py/in/x' || k || '.py', CASE WHEN k % 2 = 0 THEN 'py/u' || k || '.py' ELSE 'py/pkg' || k || '/__init__.py' END FROM p
UNION SELECT 'crate/src/main' || k || '.rs', CASE k % 3 WHEN 0 THEN 'crate/src/w' || k || '.rs' ELSE 'crate/src/w' || k || '/mod.rs' END FROM p WHERE k % 3 < 2)
SELECT source AS "from", target AS "to", 'imports' AS rel FROM t WHERE target IN (SELECT path FROM f)""")
def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    one = lambda expr, where="true": read(spark, d, "part").select(F.col("p_partkey").alias("k")).filter(where).selectExpr(f"{expr} AS path")
    files = one("'src/m' || (k % 90) || '/a' || k || '.ts'").union(one("'py/u' || k || '.py'", "k % 2 = 0")).union(one("'py/pkg' || k || '/__init__.py'", "k % 2 = 1"))
    files = files.union(one("'crate/src/w' || k || '.rs'", "k % 3 = 0")).union(one("'crate/src/w' || k || '/mod.rs'", "k % 3 = 1")).union(spark.createDataFrame([("src/lib/index.ts",), ("crate/Cargo.toml",)], "path string"))
    ts, py, rs = "'src/m' || (k % 90) || '/x' || k || '.ts'", "'py/in/x' || k || '.py'", "'crate/src/main' || k || '.rs'"
    specs = _keyed(spark, d, path=ts, spec="'../m' || ((k + 1) % 90) || '/a' || (k + 1)").union(_keyed(spark, d, path=ts, spec="'../lib'")).union(_keyed(spark, d, path=ts, spec="'react'"))
    specs = specs.union(_keyed(spark, d, path=py, spec="CASE WHEN k % 2 = 0 THEN '..u' || k ELSE '..pkg' || k END")).union(_keyed(spark, d, path=py, spec="'os'")).union(_keyed(spark, d, path=rs, spec="'crate::w' || k || '::Thing'"))
    return suggest.imported(specs, files).select("from", "to", "rel")


_SAID = "said AS (SELECT 'docs/' || k || '.md' AS source, 'fn_' || (k % 900) AS token, 1 AS n FROM p UNION ALL SELECT 'docs/' || k || '.md', 'fn_' || (k % 11), 2 FROM p UNION ALL SELECT 'docs/' || k || '.md', 'order', 1 FROM p), sym AS (SELECT 'src/' || (k % 500) || '.py' AS target, 'fn_' || (k % 700) AS token FROM p WHERE k <= 900 UNION SELECT 'src/order.py', 'order')"
_FOUND = _SAID + ", u AS (SELECT token, min(target) AS target FROM sym GROUP BY token HAVING count(DISTINCT target) = 1), m AS (SELECT source, token, sum(n) AS mentions FROM said GROUP BY ALL), f AS (SELECT source, target, token, mentions FROM m JOIN u USING (token))"


def _prose(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = "'Uses `fn_' || (k % 900) || '` and `fn_' || (k % 11) || '`, `fn_' || (k % 11) || '`, `order` not `a b`\\n  ```\\n`fn_1`\\n  ```\\n'"
    content = _keyed(spark, d, path="'docs/' || k || '.md'", text=text)
    few = read(spark, d, "part").filter("p_partkey <= 900").select(F.col("p_partkey").alias("k"))
    symbols = few.selectExpr("'src/' || (k % 500) || '.py' AS path", "'function' AS node_type", "'A.fn_' || (k % 700) AS id").union(spark.createDataFrame([("src/order.py", "class", "order"), ("src/x.py", "heading", "order")], "path string, node_type string, id string"))
    return content, symbols


@register("described_by_code", f"""WITH {_K}, {_FOUND}, kept AS (SELECT * FROM f WHERE token <> 'order'), r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY mentions DESC, token) AS i FROM kept)
SELECT source AS "from", target AS "to", token, CAST(mentions AS BIGINT) AS mentions FROM r WHERE i = 1""")
def described_by_code(spark: SparkSession, d: str) -> DataFrame:
    content, symbols = _prose(spark, d)
    words = spark.createDataFrame([("Order",), ("other",)], "word string")
    return suggest.described(content, symbols, words).select("from", "to", "token", "mentions")


@register("mentioned_in_docstrings", f"""WITH {_K}, {_SAID}, u AS (SELECT token, min(target) AS target FROM sym GROUP BY token HAVING count(DISTINCT target) = 1)
SELECT DISTINCT 'py/' || k || '.py' AS "from", target AS "to" FROM (SELECT k, 'fn_' || (k % 900) AS token FROM p UNION ALL SELECT k, 'fn_' || (k % 13) FROM p WHERE k % 2 = 0) JOIN u USING (token)""")
def mentioned_in_docstrings(spark: SparkSession, d: str) -> DataFrame:
    text = "'\"\"\"Calls fn_' || (k % 900) || '.\"\"\"\\nx = \"\"\"no fn_2\"\"\"\\ndef f():\\n    ' || CASE WHEN k % 2 = 0 THEN '\"\"\"And fn_' || (k % 13) || ' too.\"\"\"' ELSE 'pass' END || '\\n'"
    content = _keyed(spark, d, path="'py/' || k || '.py'", text=text)
    return suggest.mentioned(parsers.docstrings(content), _prose(spark, d)[1]).select("from", "to")


@register("documentation_roles", f"""WITH {_K}, {_SAID}, u AS (SELECT token, min(target) AS target FROM sym GROUP BY token HAVING count(DISTINCT target) = 1)
SELECT DISTINCT 'docs/' || k || '.rst' AS "from", target AS "to" FROM (SELECT k, 'fn_' || (k % 900) AS token FROM p UNION ALL SELECT k, 'fn_' || (k % 17) FROM p) JOIN u USING (token)""")
def documentation_roles(spark: SparkSession, d: str) -> DataFrame:
    content = _keyed(spark, d, path="'docs/' || k || '.rst'", text="'See :func:`~mod.fn_' || (k % 900) || '` and :py:meth:`text <A.fn_' || (k % 17) || '>` but fn_5.'")
    return suggest.roles(content, _prose(spark, d)[1]).select("from", "to")


@register("settings_references", f"""WITH {_K}, f AS (SELECT 'lint/l' || k || '.py' AS path FROM p WHERE k % 3 = 0) SELECT 'conf/' || k || '.json' AS "from", 'lint/l' || k || '.py' AS "to", 'references' AS rel FROM p WHERE 'lint/l' || k || '.py' IN (SELECT path FROM f)""")
def settings_references(spark: SparkSession, d: str) -> DataFrame:
    content = _keyed(spark, d, path="'conf/' || k || '.json'", text="'{\"use\": [\"lint/l' || k || '.py\", \"https://x/y.py\", \"/abs/l.py\"], \"n\": 1}'")
    files = _keyed(spark, d, path="'lint/l' || (k - k % 3) || '.py'").distinct()
    return suggest.referenced(parsers.symbols(content), files).select("from", "to", "rel")


@register("settings_references_near", f"""WITH {_K} SELECT 'conf/' || k || '.toml' AS "from", CASE WHEN k % 2 = 0 THEN 'conf/n' || k || '.py' ELSE 'lint/r' || k || '.py' END AS "to" FROM p WHERE k % 4 < 2""")
def settings_references_near(spark: SparkSession, d: str) -> DataFrame:
    content = _keyed(spark, d, path="'conf/' || k || '.toml'", text="CASE WHEN k % 2 = 0 THEN 'x = \"./n' || k || '.py\"' ELSE 'x = \"lint/r' || k || '.py\"' END")
    files = read(spark, d, "part").select(F.col("p_partkey").alias("k")).filter("k % 4 < 2").selectExpr("CASE WHEN k % 2 = 0 THEN 'conf/n' || k || '.py' ELSE 'lint/r' || k || '.py' END AS path")
    return suggest.referenced_from(content, files).select("from", "to")


@register("notebook_uses", f"""WITH {_K} SELECT 'ipynb/' || k || '.ipynb' AS "from", CASE WHEN k % 2 = 0 THEN 'a/b' || k || '.py' ELSE 'a/b' || k || '/__init__.py' END AS "to" FROM p WHERE k % 3 <> 0""")
def notebook_uses(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "part").select(F.col("p_partkey").alias("k")).filter("k % 3 <> 0").selectExpr("CASE WHEN k % 2 = 0 THEN 'a/b' || k || '.py' ELSE 'a/b' || k || '/__init__.py' END AS path")
    return suggest.notebook_uses(parsers.imports(_content(spark, d, "ipynb")), files).select("from", "to")


_WORDS = "w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS word FROM benchmark), said AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) || CASE WHEN turn % 3 = 0 THEN 'ing' WHEN turn % 3 = 1 THEN '_x' ELSE '' END AS token FROM conversations)"


def _said(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("turn") % 3 == 0, "ing").when(F.col("turn") % 3 == 1, "_x").otherwise("")
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("token")).withColumn("token", F.concat("token", ending))


@register("dictionary_filter", rf"""WITH {_WORDS}, d AS (SELECT DISTINCT word FROM w), t AS (SELECT *, lower(token) AS l FROM said WHERE length(token) >= 4),
k AS (SELECT conv_id, turn, token, regexp_matches(token, '_|[a-z][A-Z]|[A-Z][A-Z]+[a-z]|[0-9]') OR NOT (l IN (SELECT word FROM d) OR (l LIKE '%s' AND left(l, -1) IN (SELECT word FROM d)) OR (l LIKE '%es' AND left(l, -2) IN (SELECT word FROM d)) OR (l LIKE '%ed' AND left(l, -2) IN (SELECT word FROM d)) OR (l LIKE '%ing' AND left(l, -3) IN (SELECT word FROM d))) AS keep FROM t)
SELECT conv_id, turn, token, count(*) AS n FROM k WHERE keep GROUP BY ALL""")
def dictionary_filter(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1))).alias("word"))
    return suggest.plain_word(F.col("token"), words, _said(spark, d)).groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))


@register("prose_filter", rf"""WITH {_WORDS}, c AS (SELECT token FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM benchmark) GROUP BY token HAVING count(*) > 3)
SELECT token, count(*) AS n FROM said WHERE token NOT IN (SELECT token FROM c) GROUP BY token""")
def prose_filter(spark: SparkSession, d: str) -> DataFrame:
    return suggest.rare_in_prose(_said(spark, d), read(spark, d, "benchmark")).groupBy("token").agg(F.count("*").alias("n"))


@register("call_confusion", f"""WITH {_K}, c AS (SELECT CASE k % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'self' ELSE 'attr' END AS kind, 'fn_' || (k % 900) AS token FROM p), d AS (SELECT 'fn_' || (k % 700) AS token, count(*) AS defs FROM p WHERE k <= 1000 GROUP BY 1)
SELECT kind, count(*) FILTER (WHERE defs = 1) AS "UNIQUE", count(*) FILTER (WHERE defs > 1) AS "AMBIG", count(*) FILTER (WHERE defs IS NULL) AS "EXTERN" FROM c LEFT JOIN d USING (token) GROUP BY kind""")
def call_confusion(spark: SparkSession, d: str) -> DataFrame:
    call = "CASE k % 3 WHEN 0 THEN 'fn_' WHEN 1 THEN 'self.fn_' ELSE 'x.fn_' END || (k % 900) || '(1)'"
    content = _keyed(spark, d, path="'c/' || k || '.py'", text=f"'def g_' || k || '(a):\\n    if (a):\\n        ' || {call} || '  # no()\\n'")
    defs = read(spark, d, "part").filter("p_partkey <= 1000").groupBy(F.concat(F.lit("fn_"), (F.col("p_partkey") % 700).cast("string")).alias("token")).agg(F.count("*").alias("defs"))
    return links.call_confusion(parsers.calls(content), defs)


@register("heading_ladder", f"""WITH {_K} SELECT k, CASE WHEN k % 4 = 0 THEN 'H2' WHEN k % 4 = 1 THEN 'H3' ELSE 'H1' END AS stage, CASE WHEN k % 4 = 0 THEN 'part-' || k || '-2' WHEN k % 4 > 1 THEN 'part-' || k END AS target FROM p""")
def heading_ladder(spark: SparkSession, d: str) -> DataFrame:
    now = _keyed(spark, d, path="'d' || k || '.md'", slug="CASE k % 4 WHEN 0 THEN 'part-' || k || '-2' WHEN 1 THEN 'gone' ELSE 'part-' || k END", title="CASE k % 4 WHEN 1 THEN 'Gone' ELSE 'Part ' || k END", pos="0")
    old = _keyed(spark, d, k="k", path="'d' || k || '.md'", slug="'part-' || k", hint="'Part ' || k")
    return resolve.heading_ladder(old, now).select("k", "stage", "target")


@register("column_ladder", f"WITH {_K} SELECT k, CASE WHEN k % 5 = 0 THEN 'C2' ELSE 'C1' END AS stage, CASE WHEN k % 5 <> 0 THEN 'n' || (k % 7) END AS target FROM p")
def column_ladder(spark: SparkSession, d: str) -> DataFrame:
    now = _keyed(spark, d, path="'t' || k || '.csv'", name="CASE WHEN k % 5 = 0 THEN 'other' ELSE 'n' || (k % 7) END")
    return resolve.column_ladder(_keyed(spark, d, k="k", path="'t' || k || '.csv'", name="'n' || (k % 7)"), now).select("k", "stage", "target")


@register("row_ladder", """WITH o AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS n, l_partkey || ':' || substr(sha256(l_partkey || ',' || l_suppkey), 1, 8) AS hint FROM lineitem), w AS (SELECT ok, CAST(n + CASE WHEN ok % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n, hint FROM o WHERE NOT (ok % 7 = 0 AND n = 1)),
m AS (SELECT ok, hint, min(n) AS t FROM w GROUP BY ALL) SELECT o.ok AS order_key, o.n AS line, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.ok = o.ok AND w.n = o.n AND w.hint = o.hint) THEN 'I1' WHEN m.t IS NOT NULL THEN 'I2' ELSE 'I3' END AS stage,
CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.ok = o.ok AND w.n = o.n AND w.hint = o.hint) THEN o.n ELSE m.t END AS target FROM o LEFT JOIN m USING (ok, hint)""")
def row_ladder(spark: SparkSession, d: str) -> DataFrame:
    """An order is a table, a line item a row; rows have shifted in every third and the first is gone in every seventh."""
    text = F.concat_ws(",", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    old = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), long("l_linenumber").alias("n"), resolve.row_hint(F.col("l_partkey").cast("string"), text).alias("hint"))
    now = old.filter("NOT (path % 7 = 0 AND n = 1)").withColumn("n", F.col("n") + F.when(F.col("path") % 3 == 0, 1).otherwise(0))
    return resolve.row_ladder(old, now).select(F.col("path").alias("order_key"), F.col("n").alias("line"), "stage", "target")


@register("rename_rings", f"""WITH {_K} SELECT 'x' || k AS source, 'r' || (k - k % 3) AS target, 'ring' || (k - k % 3 + 2) AS commit FROM p WHERE k % 3 = 0""")
def rename_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings of three names, and a name that leads into each: names of a ring come back to themselves and drop out."""
    ring = read(spark, d, "part").select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"), F.col("p_partkey").alias("k")).filter("k % 3 = 0")
    rings = ring.selectExpr("k * 4 + i AS seq", "'r' || (k + i) AS old", "'r' || (k + (i + 1) % 3) AS new", "'ring' || (k + i) AS commit")
    return graph.rename_closure(rings.union(ring.filter("i = 0").selectExpr("k * 4 + 3 AS seq", "'x' || k AS old", "'r' || k AS new", "'in' || k AS commit"))).select("source", "target", "commit")


_CONF = "e AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'uses' ELSE 'mentions' END AS rel, CASE WHEN o_orderkey % 5 = 0 THEN 'probable' ELSE 'certain' END AS confidence FROM orders)"


def _confident(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, d, "orders").select(F.concat(F.lit("o"), key.cast("string")).alias("source"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target"), F.when(key % 2 == 0, "uses").otherwise("mentions").alias("rel"), F.when(key % 5 == 0, "probable").otherwise("certain").alias("confidence"))


@register("focus_view", f"WITH {_CONF}, f AS (SELECT target AS focus FROM e ORDER BY target LIMIT 1) SELECT e.* FROM e, f WHERE target = focus AND confidence = 'certain' AND rel = 'uses'")
def focus_view(spark: SparkSession, d: str) -> DataFrame:
    edges = _confident(spark, d)
    focus = edges.agg(F.min("target")).first()[0]  # one name
    return graph.focused(edges, focus, rels=["uses"])


@register("filtered_view", f"""WITH {_CONF}, n AS (SELECT source AS id FROM e UNION SELECT target FROM e), s AS (SELECT id FROM n WHERE contains(id, '1')), l AS (SELECT source, target FROM e WHERE rel = 'uses' AND source IN (SELECT id FROM s) AND target IN (SELECT id FROM s))
SELECT id FROM s WHERE id IN (SELECT source FROM l UNION SELECT target FROM l)""")
def filtered_view(spark: SparkSession, d: str) -> DataFrame:
    edges = _confident(spark, d)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().select("id", F.col("id").alias("label"), F.lit("file").alias("kind"))
    return graph.filtered(nodes, edges, rels=["uses"], label="1", orphans=False)[0].select("id")


@register("refresh_gates", f"""WITH {_K}, b AS (SELECT k % 40 AS batch, CASE k % 4 WHEN 0 THEN 'a.json' WHEN 1 THEN 'b.md' WHEN 2 THEN 'c.txt' ELSE 'd.go' END AS path, CASE WHEN k % 37 = 5 THEN 'Added' ELSE 'Modified' END AS change FROM p)
SELECT batch, bool_or(change <> 'Modified' OR path = 'a.json') AS derived, bool_or(change <> 'Modified' OR path IN ('b.md', 'd.go')) AS suggested FROM b GROUP BY batch""")
def refresh_gates(spark: SparkSession, d: str) -> DataFrame:
    each = _keyed(spark, d, batch="k % 40", path="CASE k % 4 WHEN 0 THEN 'a.json' WHEN 1 THEN 'b.md' WHEN 2 THEN 'c.txt' ELSE 'd.go' END", change="CASE WHEN k % 37 = 5 THEN 'Added' ELSE 'Modified' END")
    return changes.refreshes(each, "batch")


@register("event_storms", "SELECT root FROM (SELECT event_type AS root, count(DISTINCT user_id) AS n FROM events GROUP BY 1) WHERE n > 30")
def event_storms(spark: SparkSession, d: str) -> DataFrame:
    batch = read(spark, d, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path"))
    return changes.storms(batch, 30)


_AFTER = r"now AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' freshly edited' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1)"


@register("index_upkeep", rf"WITH {_AFTER}, t AS (SELECT lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'))) AS term, 'd' || doc_id || '.md' AS path FROM now) SELECT term, path, CAST(least(count(*), 255) AS INTEGER) AS tf FROM t GROUP BY ALL")
def index_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Postings after a tenth of the documents was edited and a tenth removed, from the old ones and the changes."""
    old, now, diff = _edited(spark, d)
    return changes.reindexed(*_tables(old), diff, now)[0].select("term", "path", "tf")


@register("symbol_upkeep", f"WITH {_AFTER} SELECT 'd' || doc_id || '.md' AS path, 'h' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '-new' ELSE '' END AS id FROM now")
def symbol_upkeep(spark: SparkSession, d: str) -> DataFrame:
    old, now, diff = _edited(spark, d)
    titled = lambda df, more: df.withColumn("text", F.concat(F.lit("# H"), F.regexp_extract("path", "([0-9]+)", 1), more))
    new = F.when(F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 10 == 0, " new").otherwise("")
    return changes.reindexed(*_tables(titled(old, F.lit(""))), diff, titled(now, new))[2].select("path", "id")


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    now = docs.filter("doc_id % 10 <> 1").select(path, F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" freshly edited"))).otherwise(F.col("text")).alias("text"))
    diff = docs.filter("doc_id % 10 < 2").select(path, F.when(F.col("doc_id") % 10 == 0, "Modified").otherwise("Removed").alias("change"))
    return docs.select(path, "text"), now, diff


def _tables(content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return search.postings(content, "text", "path"), search.lengths(content, "text", "path"), parsers.symbols(content)
