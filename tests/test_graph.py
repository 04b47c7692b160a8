from datetime import datetime

from fathomgrid.operators import graph, links, resolve


def edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, rel string")


def test_containment(spark):
    files = spark.createDataFrame([("src/nested/deep.py", 5), ("top.md", 9)], "path string, t long")
    nodes = {r.id: r for r in graph.nodes(files, "t").collect()}
    assert nodes["src/nested/deep.py"].ext == "py" and nodes[""].time == 5 and nodes["src"].kind == "folder"
    assert {(r.source, r.target) for r in graph.contains(files).collect()} == {("", "src"), ("", "top.md"), ("src", "src/nested"), ("src/nested", "src/nested/deep.py")}


def test_neighbors(spark):
    e = edges(spark, [("a", "b", "imports"), ("b", "c", "references"), ("c", "a", "imports"), ("d", "a", "imports")])
    got = lambda **k: {(r.id, r.depth) for r in graph.neighbors(e, ["a"], **k).collect()}
    assert got() == {("b", 1), ("c", 1), ("d", 1)}
    assert got(direction="out", depth=5) == {("b", 1), ("c", 2)}
    assert got(rels=["references"], depth=9) == set()
    assert [r.id for r in graph.neighbors(e, ["a"], limit=2, depth=3).collect()] == ["b", "c"]


def test_hints(spark):
    e = edges(spark, [("a", "b", "imports"), ("c", "b", "imports"), ("b", "a", "references")])
    row = {r.id: r for r in graph.hint_maps(e).collect()}["b"]
    assert row["in"] == {"imports": 2} and row["out"] == {"references": 1}


def test_rename_chain(spark):
    ev = spark.createDataFrame([(0, "b", "c", "k2"), (1, "a", "b", "k1")], "seq long, old string, new string, commit string")
    assert {(r.source, r.target, r.commit) for r in graph.rename_closure(ev).collect()} == {("a", "c", "k2"), ("b", "c", "k2")}
    back = spark.createDataFrame([(0, "a", "b", "k1"), (1, "b", "a", "k2")], "seq long, old string, new string, commit string")
    assert graph.rename_closure(back).count() == 0


def test_fold(spark):
    log = spark.createDataFrame([("l1", "add", "x", 1), ("l1", "del", "x", 2), ("l2", "add", "y", 1), ("l2", "retarget", "z", 3)], "id string, op string, target string, ts long")
    assert [(r.id, r.target) for r in graph.fold(log).collect()] == [("l2", "z")]


def test_snapshot_diff(spark):
    s = "path string, size long"
    old = spark.createDataFrame([("stable", 1), ("changed", 1), ("removed", 1)], s)
    new = spark.createDataFrame([("stable", 1), ("changed", 2), ("new", 1)], s)
    assert {(r.path, r.change) for r in links.snapshot_diff(old, new, ["size"]).collect()} == {("changed", "Modified"), ("removed", "Removed"), ("new", "Added")}


def test_batch_kinds(spark):
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "path string")
    got = links.batch_changes(p("a", "b", "c", "d", "a"), exists=p("a", "b"), known=p("a", "c"))
    assert {(r.path, r.change) for r in got.collect()} == {("a", "Modified"), ("b", "Added"), ("c", "Removed")}


def test_debounce(spark):
    rows = [(1, datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 5)]
    got = links.debounced(spark.createDataFrame(rows, "u long, ts timestamp"), "u", "ts", "2 seconds").collect()
    assert sorted(r.n for r in got) == [1, 2]


def test_unique_matches_and_best_token(spark):
    said = spark.createDataFrame([("d", "x"), ("d", "y"), ("d", "y"), ("d", "z")], "s string, token string")
    names = spark.createDataFrame([("f", "x"), ("f", "y"), ("f", "z"), ("g", "z")], "t string, token string")
    m = links.unique_matches(said, names, "s", "t")
    assert {(r.token, r.mentions) for r in m.collect()} == {("x", 1), ("y", 2)}
    assert links.best_token(m, "s", "t").first().token == "y"


def test_cochange(spark):
    rows = [(c, f) for c in range(5) for f in "ab"] + [(9, f) for f in "abcdefghijklmn"]
    assert [(r.a, r.b, r.n) for r in links.cochanged(spark.createDataFrame(rows, "commit long, file string")).collect()] == [("a", "b", 5)]


def test_ladders(spark):
    s = "path string, sym string"
    old = spark.createDataFrame([("a.py", "f"), ("B.py", "g"), ("c.py", "h"), ("d/e.py", "i"), ("gone.py", "j")], s)
    now = spark.createDataFrame([("a.py", "f"), ("b.py", "g"), ("moved.py", "h"), ("x/e.py", "i")], s)
    alias = spark.createDataFrame([("c.py", "moved.py")], "source string, target string")
    got = {r.path: r.stage for r in resolve.file_ladder(old, now.select("path"), alias).collect()}
    assert got == {"a.py": "F1", "B.py": "F1a", "c.py": "F2", "d/e.py": "L3", "gone.py": "BROKEN"}
    got = {r.path: r.stage for r in resolve.symbol_ladder(old, now, alias).collect()}
    assert got == {"a.py": "S1", "B.py": "S3", "c.py": "S2", "d/e.py": "S3", "gone.py": "GONE"}


def test_sketch_matches_find_an_edited_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    left = spark.createDataFrame([(1, base.replace("w30", "q"))], "id long, text string")
    right = spark.createDataFrame([(7, base), (8, "something else entirely here")], "id long, text string")
    r = resolve.sketch_matches(left, right).first()
    assert r.match == 7 and r.jaccard > 0.85


def test_sketch_matches_send_no_full_sets_of_texts_that_differ(spark):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(400)) + " one common end") for i in range(60)] + [(60, " ".join(f"w0x{j}" for j in range(390)))]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(4)
    written = lambda: sum(e.totalShuffleWrite() for e in seq(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {(r.id, r.match) for r in resolve.sketch_matches(docs, docs, size=1000, others=True).collect()}
        assert got == {(0, 60), (60, 0)}
        assert written() - before < 2_000_000  # 60 texts have 40 candidates each, of 400 shingles
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketch_matches_of_equal_sets_and_of_two_tables(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words).upper()), (3, " ".join(words)), (4, " ".join(words[:30])), (5, "a b"), (6, "a b"), (7, None), (8, " ".join(words[20:]))]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id, r.match, r.jaccard) for r in resolve.sketch_matches(docs, docs, others=True).collect()}
    assert got == {(1, 3, 1.0), (3, 1, 1.0), (4, 1, 0.736842), (8, 1, 0.473684)}
    right = spark.createDataFrame([("x", rows[3][1]), ("y", rows[7][1]), ("z", "c d")], "id string, text string")
    got = {(r.id, r.match, r.jaccard) for r in resolve.sketch_matches(docs, right).collect()}
    assert got == {(1, "x", 0.736842), (3, "x", 0.736842), (4, "x", 1.0), (8, "y", 1.0)}
