import json
import os

import pytest

from fathomgrid.operators import suggest
from fathomgrid.plans.tree import Tree, answer
from fathomgrid.sources import files as src
from fathomgrid.sources import parsers
from fathomgrid.streaming import changes

FILES = {
    "router.py": "import os\n\nclass TeacherRouter:\n    def select(self):\n        return 1\n",
    "main.py": "from .router import TeacherRouter\n",
    "guide.md": "# Guide\nSee `TeacherRouter` here. #howto\n## Setup\ntext\n",
    "conf.json": '{"entry": "router.py", "n": 1}',
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("t")
    for p, b in FILES.items():
        (root / p).write_text(b)
    return Tree(spark, str(root))


def test_search(tree):
    hits = tree.search("router")
    assert hits[0] == {"uri": "vault://router.py", "type": "file", "preview": ""}
    assert "vault://router.py#TeacherRouter.select" in [h["uri"] for h in tree.search("select", "symbol")]
    assert [h["uri"] for h in tree.search("setup", "text")] == ["vault://guide.md"]
    assert [h["uri"] for h in tree.search("ext:json")] == ["vault://conf.json"]
    assert len(tree.search("e", limit=0)) == 1


def test_read(tree):
    assert tree.read("vault://guide.md#h:setup") == "## Setup\ntext\n"
    assert tree.read("vault://router.py#TeacherRouter.select").startswith("def select")
    assert tree.read("vault://guide.md", (1, 1)) == "# Guide"
    with pytest.raises(PermissionError):
        tree.read("vault://nothing.md")
    with pytest.raises(ValueError):
        tree.read("vault://../x")


def test_links_and_neighbors(tree):
    assert {(r.source, r.rel, r.target) for r in tree.links().collect()} == {("vault://main.py", "imports", "vault://router.py"), ("vault://conf.json", "references", "vault://router.py")}
    assert [n["uri"] for n in tree.neighbors("vault://router.py", direction="in")] == ["vault://conf.json", "vault://main.py"]
    assert tree.neighbors("vault://router.py", rels=["uses"]) == []


def test_suggestions_and_decisions(tree):
    s = tree.suggestions().collect()
    assert [(r["from"], r["to"], r.token, r.mentions) for r in s] == [("guide.md", "router.py", "TeacherRouter", 1)]
    tree.decide("guide.md", "router.py", True)
    assert tree.suggestions().count() == 0
    assert ("vault://guide.md", "describes") in {(r.source, r.rel) for r in tree.links().collect()}
    nodes, edges = tree.graph()
    assert nodes.count() == 5 and edges.filter("rel = 'describes'").count() == 1


def test_pending_and_rpc(tree):
    pid = json.loads(answer(tree, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "vault_propose_link", "arguments": {"source": "a", "rel": "uses", "target": "b", "rationale": "r"}}})))
    assert pid["result"]["content"][0]["text"].startswith("p_")
    call = lambda **k: json.loads(answer(tree, json.dumps({"jsonrpc": "2.0", "id": 1, **k})))
    assert call(method="ping")["result"] == {} and len(call(method="tools/list")["result"]["tools"]) == 4
    assert call(method="tools/call", params={"name": "vault_read", "arguments": {"uri": "vault://no"}})["result"]["isError"]
    assert call(method="tools/call", params={"name": "vault_neighbors", "arguments": {"uri": "vault://zz"}})["result"]["content"][0]["text"] == "No results."
    assert answer(tree, json.dumps({"jsonrpc": "2.0", "method": "x"})) is None and "error" in call(method="nope")


def test_files(tree):
    tree.save_file("new/a.md", "---\nt: 1\n---\nx")
    assert tree.open_file("new/a.md")["frontmatter"] == [("t", "1")]
    assert tree.read_base64("conf.json") == "eyJlbnRyeSI6ICJyb3V0ZXIucHkiLCAibiI6IDF9"
    with pytest.raises(ValueError):
        tree.save_file("/etc/x", "")
    assert tree.schema_state() == "FirstRun" and tree.schema_state() == "Match"
    assert tree.tags().first().tag == "howto" and tree.stats().first().files == 4
    held = tree.lock()
    with pytest.raises(BlockingIOError):
        tree.lock()
    held.close()


def content(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def test_imports(spark):
    c = content(spark, {"src/a.ts": "import x from './b';import y from 'react'", "src/b.tsx": "", "p/m.py": "from .util import z\nfrom . import q\nimport os", "p/util.py": "", "k/Cargo.toml": "", "k/src/lib.rs": "mod x;\nuse crate::a::b::C;\nuse self::y;", "k/src/x.rs": "", "k/src/a/b.rs": ""})
    got = suggest.imported(parsers.imports(c), c.select("path"))
    assert {(r["from"], r["to"]) for r in got.collect()} == {("src/a.ts", "src/b.tsx"), ("p/m.py", "p/util.py"), ("k/src/lib.rs", "k/src/x.rs"), ("k/src/lib.rs", "k/src/a/b.rs")}


def test_notebook_imports(spark):
    nb = json.dumps({"cells": [{"cell_type": "code", "source": "import pkg.mod\nimport os\nfrom pkg import x"}]})
    c = content(spark, {"n.ipynb": nb, "pkg/mod.py": "", "pkg/__init__.py": ""})
    assert {r["to"] for r in suggest.notebook_uses(parsers.imports(c), c.select("path")).collect()} == {"pkg/mod.py", "pkg/__init__.py"}


def test_references(spark):
    c = content(spark, {"a.toml": 'x = "lint.py"\ny = "https://lint.py"\nz = "/lint.py"\nw = "none.py"', "b.yaml": "k: lint.py", "lint.py": ""})
    assert {(r["from"], r["to"]) for r in suggest.referenced(parsers.symbols(c), c.select("path")).collect()} == {("a.toml", "lint.py"), ("b.yaml", "lint.py")}


def test_descriptions(spark):
    c = content(spark, {"a.py": "class Cache: pass\nclass Config2: pass\ndef handle_data(): pass\ndef format_data(): pass\n", "b.py": "def twice(): pass\n", "c.py": "def twice(): pass\n", "d.md": "`Cache` `twice` `handle_data` `handle_data`\n```\n`format_data`\n```\n", "e.md": "`format_data` `open`"})
    words = spark.createDataFrame([("cache",), ("open",)], "word string")
    got = suggest.described(c, parsers.symbols(c), words).collect()
    assert [(r["from"], r.token, r.mentions) for r in got] == [("d.md", "handle_data", 2), ("e.md", "format_data", 1)]
    assert suggest.described(c, parsers.symbols(c), loose=True).count() == 2


def test_roles_and_docstrings(spark):
    c = content(spark, {"a.py": "class Widget: pass\n", "d.rst": "See :class:`~pkg.Widget` and :func:`nothing`."})
    assert [r["to"] for r in suggest.roles(c, parsers.symbols(c)).collect()] == ["a.py"]
    docs = content(spark, {"b.py": "Uses Widget and the word."})
    assert [r["from"] for r in suggest.mentioned(docs, parsers.symbols(c)).collect()] == ["b.py"]


def test_lost_events_are_reconciled(spark, make):
    root = make({"a.txt": "1", "b.txt": "2", ".vault/x": "y"})
    old = src.scan(spark, root).cache()
    assert old.count() == 2
    os.remove(f"{root}/b.txt")
    open(f"{root}/c.txt", "w").write("3")
    new = src.scan(spark, root)
    files, found = changes.reconciled(old, new)
    assert {(r.path, r.change) for r in found.collect()} == {("b.txt", "Removed"), ("c.txt", "Added")}
    assert sorted(r.path for r in files.collect()) == ["a.txt", "c.txt"]
    batch = spark.createDataFrame([("c.txt",), ("b.txt",), ("zz",), (".vault/x",)], "path string")
    files, found = changes.applied(old, batch, new)
    assert {(r.path, r.change) for r in found.collect()} == {("b.txt", "Removed"), ("c.txt", "Added")}
    assert sorted(r.path for r in files.collect()) == ["a.txt", "c.txt"]


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path":"a"}\n{"path":"a"}\n{"path":".vault/z"}\n')
    seen = []
    q = changes.watch(spark.readStream.schema("path string").json(str(tmp_path / "in")), lambda df, _: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert seen == ["a"]
