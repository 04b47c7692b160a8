import json
import subprocess

import pytest

from fathomgrid.sources import files as src
from fathomgrid.sources import ignore, parsers


def scanned(spark, root, **k):
    return sorted(r.path for r in src.scan(spark, root, src.Settings(**k) if k else None).collect())


def test_ignore_files(spark, make):
    root = make({".gitignore": "vendored/\n", ".git/HEAD": "x", "vendored/dep.py": "", "kept.py": ""})
    assert scanned(spark, root) == [".gitignore", "kept.py"]


def test_ignore_without_a_repository(spark, make):
    root = make({"project/.gitignore": "node_modules/", "project/node_modules/a.js": "", "project/app.js": ""})
    assert scanned(spark, root) == ["project/.gitignore", "project/app.js"]


@pytest.mark.parametrize(
    ("rules", "path", "folder", "hit"),
    [
        ("*.log", "a/b.log", False, True),
        ("/x", "a/x", False, False),
        ("a/**/z", "a/b/c/z", False, True),
        ("*.log\n!keep.log", "keep.log", False, False),
        ("build/", "build", False, False),
        ("build/", "x/build", True, True),
        ("a?c", "abc", False, True),
        ("[ab].txt", "c.txt", False, False),
        ("# note\n\n", "note", False, False),
        ("doc/*.txt", "doc/x/y.txt", False, False),
    ],
)
def test_ignore_patterns(rules, path, folder, hit):
    assert ignore.ignored(path, folder, ignore.rules(rules)) is hit


def test_default_patterns_and_settings(spark, make):
    root = make({"node_modules/a.js": "", "a.py": "", "gen/x.py": "", ".vault/vault.toml": '[ignore]\npatterns = ["gen/"]\n[limits]\ncontent_bytes = 500\n[extra]\nk = "v"\n'})
    assert scanned(spark, root) == ["a.py", "node_modules/a.js"]
    s = src.Settings.read(root)
    assert s.content_bytes == 500 and s.other == {"extra": {"k": "v"}}
    s.name = "n"
    s.write(root)
    assert src.Settings.read(root) == s
    assert src.Settings.read(make({}, "other")).patterns == src.DEFAULT_PATTERNS


def test_content_skips_what_is_not_text(spark, make):
    root = make({"binary.dat": b"a\0b", "huge.txt": "x" * ((1 << 20) + 1), "bad.txt": b"\xff\xfe", "normal.txt": "hello"})
    f = src.scan(spark, root)
    assert [r.path for r in src.content(spark, root, f).collect()] == ["normal.txt"]


def test_logs(spark, tmp_path):
    path = str(tmp_path / "x" / "links.jsonl")
    assert src.records(spark, path, src.LINKS).count() == 0
    src.append(path, "links", {"id": "l1", "op": "add", "from": 'has "_type" in it', "rel": "r", "to": "b"})
    src.append(path, "links", {"id": "l2", "op": "add", "from": "a", "rel": "r", "to": "b"})
    assert json.loads(open(path).readline()) == {"_type": "links", "_v": 1}
    assert sorted(r.id for r in src.records(spark, path, src.LINKS).collect()) == ["l1", "l2"]
    src.replace(path, "links", src.records(spark, path, src.LINKS).filter("id = 'l2'"))
    assert [r.id for r in src.records(spark, path, src.LINKS).collect()] == ["l2"]


def test_rename_events(spark, make):
    text = "commit\tk2\t2024-01-02T00:00:00Z\n\nR100\tb\tc\ncommit\tk1\t2024-01-01T00:00:00Z\nR090\ta\tb\n"
    assert [(e[1], e[2], e[3]) for e in src.rename_events(text)] == [("b", "c", "k2"), ("a", "b", "k1")]
    root = make({"a.txt": "one\ntwo\nthree\n"})
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    git("mv", "a.txt", "b.txt")
    git("commit", "-qm", "y")
    assert [(r.old, r.new) for r in src.renames(spark, root).collect()] == [("a.txt", "b.txt")]
    assert [r.file for r in src.commits(spark, root).collect()] == ["b.txt", "a.txt"]


def ids(parsed):
    return [(s.id, s.node_type) for s in parsed[0]]


def test_python():
    t = "import os.path as q, sys\nfrom ..a import b\n@d\ndef route():\n  x = 'def no'\n\nclass Config(B):\n    '''def no'''\n    async def load(self):\n        def inner(): pass\n"
    assert ids(parsers.python(t)) == [("route", "function"), ("Config", "class"), ("Config.load", "method"), ("Config.load.inner", "method")]
    assert parsers.python(t)[1] == ["os.path", "sys", "..a"]
    s = parsers.python(t)[0][0]
    assert t[s.start : s.end] == "def route():\n  x = 'def no'"


BASE = "import os\n\ndef first(a):\n    return a\n\nclass C:\n    def one(self):\n        x = [1,\n             2]\n        return x\n\n    def two(self):\n        return 'text'\n\ndef last():\n    pass\n"


@pytest.mark.parametrize("edit", [lambda t: t + "def process_", lambda t: t.replace("return a", "return (a"), lambda t: t.replace("'text'", "'text"), lambda t: t + "if True:", lambda t: t.replace("    return a\n", ""), lambda t: t.replace("        return x", "    return x")])
def test_python_in_the_middle_of_an_edit(edit):
    before = {s.id for s in parsers.python(BASE)[0]}
    after = {s.id for s in parsers.python(edit(BASE))[0]}
    assert len(before & after) / len(before) >= 0.95


def test_go():
    t = 'package x\nimport (\n "fmt"\n m "a/b"\n)\ntype R struct { a int }\ntype (\n A interface{}\n B int\n)\nfunc (r *R) M(x int) { if true { } }\nfunc F() {}\n'
    assert ids(parsers.go(t)) == [("R", "struct"), ("A", "interface"), ("B", "type"), ("R.M", "method"), ("F", "function")]
    assert parsers.go(t)[1] == ["fmt", "a/b"]


def test_rust():
    t = 'use crate::a::b;\nmod x;\nstruct Config { a: u8 }\nimpl<T> Container<T> { fn get(&self) -> &\'a str { "fn no" } }\nimpl fmt::Display for Config { fn fmt(&self) {} }\ntrait Shape { fn area(&self); }\nmod tests { fn x() {} }\nfn main() { fn inner() {} }\n'
    assert ids(parsers.rust(t)) == [("Config", "struct"), ("Container.get", "method"), ("Config.fmt", "method"), ("Shape", "trait"), ("Shape.area", "method"), ("tests.x", "function"), ("main", "function")]
    assert parsers.rust(t)[1] == ["crate::a::b", "mod:x"]
    assert ids(parsers.rust("struct A {}\nfn whole() {}\nfn cut( {"))[:2] == [("A", "struct"), ("whole", "function")]


def test_typescript():
    t = "import {a} from './a';\nexport class T { constructor(x) {}\n  load(a: string): void { if (a) { } }\n}\nexport interface I { m(x: number): void; p: string }\nfunction f() {}\nconst z = require('zz')\n"
    assert ids(parsers.typescript(t)) == [("T", "class"), ("T.constructor", "method"), ("T.load", "method"), ("I", "interface"), ("I.m", "method"), ("f", "function")]
    assert parsers.typescript(t)[1] == ["./a", "zz"]


def test_documents():
    md = "# Teacher Router\n```\n# no\n```\n## Setup\nx\n## Setup\n# B\n"
    got = parsers.markdown(md)[0]
    assert [(s.id, md[s.start : s.end][:4]) for s in got] == [("teacher-router", "# Te"), ("setup", "## S"), ("setup-2", "## S"), ("b", "# B\n")]
    assert got[0].end == got[3].start
    assert [s.id for s in parsers.underlined("====\nTitle\n=====\n\nlonger\n--\n")[0]] == ["title"]


def test_data_files():
    p, _, partial = parsers.json_file('{"tags":["a"],"a/b":{"c":1.5},"n":null,"t":true}')
    assert [(s.id, s.node_type) for s in p] == [("/a~1b", "object"), ("/a~1b/c", "number"), ("/n", "null"), ("/t", "boolean"), ("/tags", "array"), ("/tags/0", "string")] and not partial
    assert parsers.json_file("{") == ([], [], True)
    assert ids(parsers.yaml_file("a: {b: [1]}\n2: x\n")) == [("/a", "mapping"), ("/a/b", "sequence"), ("/a/b/0", "number"), ("/2", "string")]
    assert ids(parsers.toml_file("[t]\nd = 2024-01-01\nx = 1\n")) == [("/t", "table"), ("/t/d", "datetime"), ("/t/x", "number")]
    assert [s.id for s in parsers.csv_file('\ufeffname,"label",,score\n1,2')[0]] == ["name", "label", "score"]
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["import x\n", "def f(): pass"]}, {"cell_type": "markdown", "source": "# Head"}]})
    assert ids(parsers.notebook(nb)) == [("f", "function"), ("head", "heading")] and parsers.notebook(nb)[1] == ["x"]
    assert parsers.notebook("nope")[2]


def test_symbol_table_has_byte_ranges(spark):
    df = spark.createDataFrame([("é.py", "# é\ndef f():\n    pass\n"), ("x.unknown", "def g(): pass")], "path string, text string")
    r = parsers.symbols(df).collect()
    assert [(x.id, x.start, x.end) for x in r] == [("f", 5, 22)] and len(r[0].sketch) == 32
    parsers.register("unknown", parsers.python)
    try:
        assert parsers.symbols(df).count() == 2
    finally:
        del parsers.PARSERS["unknown"]


def test_frontmatter():
    assert parsers.frontmatter("---\ntitle: Hello World\nstatus: draft\n---\nbody") == [("title", "Hello World"), ("status", "draft")]
    assert parsers.frontmatter("no") == []


def test_indented_and_empty_headings():
    found, _, _ = parsers.markdown("  # One\n   ```\n   # no\n   ```\n# \n#\n####### no\n\t## Two ##\n#three\n")
    assert [(s.id, s.name, s.start) for s in found] == [("one", "One", 0), ("two", "Two", 46)]


def test_underlined_titles_end_after_their_line():
    text = "Title\n=====\ntext\n\nLast\n----"
    found, _, _ = parsers.underlined(text)
    assert [text[s.start : s.end] for s in found] == ["Title\n=====\n", "Last\n----"]


def test_calls_and_docstrings(spark):
    text = '"""Module doc."""\nclass A:\n    """Class doc."""\n    def f(self, x):\n        \'\'\'Doc of f.\'\'\'\n        if (x):  # no(1)\n            return self.g(h(x.k("s(2)")))\n'
    content = spark.createDataFrame([("a.py", text), ("b.md", text)], "path string, text string")
    assert sorted((r.kind, r.token) for r in parsers.calls(content).collect()) == [("attr", "k"), ("bare", "h"), ("self", "g")]
    assert sorted(r.text for r in parsers.docstrings(content).collect()) == ["Class doc.", "Doc of f.", "Module doc."]


def test_blobs_of_a_revision(spark, make):
    root = make({"a.py": "x = 1\n", "b/c.py": "y = 2\n", "d.txt": "no"})
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("rm", "-q", "a.py")
    git("commit", "-qm", "two")
    assert {(r.path, r.text) for r in src.at_revision(spark, root, "HEAD~1").collect()} == {("a.py", "x = 1\n"), ("b/c.py", "y = 2\n")}
    assert [r.path for r in src.deleted(spark, root).collect()] == ["a.py"]
    assert src.at_revision(spark, root + "/none").count() == 0


def test_parts_are_parsed_in_many_tasks(spark, tmp_path):
    from fathomgrid.plans import parsed, registry  # noqa: F401

    spark.range(1, 41).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = registry.queries()["symbols_yaml"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 4 and out.count() == 240


def test_yaml_is_read_as_by_the_python_loader():
    import yaml

    for text in ("a: [1, {b: c}]\n", "- &x {k:[]}\n- *x\n", "a\tq\n\"?b\n", "? !\n: c\n", "a:\n- 1.5\n- 2020-01-01\n- yes\n", "a: b: c\n", "- " * 2000 + "x"):
        try:
            want = yaml.safe_load(text)
        except Exception:
            assert parsers.yaml_file(text) == ([], [], True)
        else:
            assert repr(parsers._yaml(text)) == repr(want)
