import duckdb
import pytest

from fathomgrid.operators import documents
from fathomgrid.plans import registry, relational, structure  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_sections(spark):
    heads = spark.createDataFrame([(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 2, 30), (1, 1, 40)], "d long, level int, start long")
    assert {r.start: r.end for r in documents.sections(heads, "d").collect()} == {0: 40, 10: 30, 20: 30, 30: 40, 40: None}


def test_fences_and_offsets(spark):
    docs = spark.createDataFrame([(1, "é\n```\n# x\n```\n# y")], "d long, text string")
    rows = documents.fenced(documents.lines(docs, "d"), "d", documents.F.col("line").startswith("```"))
    assert [(r.start, r.inside) for r in rows.orderBy("pos").collect()] == [(0, False), (3, False), (7, True), (11, True), (15, False)]


def test_titles(spark):
    docs = spark.createDataFrame([(1, "Title\n=====\n\nlonger\n--\nx")], "d long, text string")
    assert [r.title for r in documents.titles(documents.lines(docs, "d"), "d").collect()] == ["Title"]


def test_retarget_rules(spark):
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "path string")
    got = documents.retarget_rules(p("src/a/x.py", "src/b/y.py", "src/z.py"), p("lib/src/a/x.py", "lib/src/b/y.py", "q/z.py", "r/z.py"))
    assert [(r.old_prefix, r.new_prefix, r.n) for r in got.collect()] == [("", "lib", 2)]


def test_staged_ladder(spark):
    old = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "m")], "path string, key string")
    one = spark.createDataFrame([("a", "t1")], "path string, target string")
    two = spark.createDataFrame([("k", "t2")], "key string, target string")
    assert {r.path: (r.stage, r.target) for r in documents.staged(old, [("S1", one, ["path"]), ("S2", two, ["key"])], "GONE").collect()} == {"a": ("S1", "t1"), "b": ("S2", "t2"), "c": ("GONE", None)}


@pytest.mark.parametrize("name", ["bm25_topk", "heading_sections", "neighbors_bfs_depth2", "cochange_pairs", "file_ladder", "exact_jaccard"])
def test_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    r = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    want = sorted(map(str, r.fetchall()))
    assert sorted(str(tuple(x[c] for c in columns)) for x in registry.queries()[name](spark, d).collect()) == want
