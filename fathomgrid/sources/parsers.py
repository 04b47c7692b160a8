"""Symbols and imports of source files, by scanners that bear text in the middle of an edit.

A parser takes a text and returns (symbols, imports, partial); a symbol is (id,
node_type, name, start, end) in characters.  Code scanners first blank out strings and
comments, so that what is left can be searched by plain patterns: an unclosed string
ends at its line, an unclosed bracket hides nothing.  ``register`` adds parsers.
"""

from __future__ import annotations

import json
import keyword
import re
import tomllib
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.functions.text import sketch


class Symbol(NamedTuple):
    id: str
    node_type: str
    name: str
    start: int
    end: int
    source: str | None = None


Parsed = tuple[list[Symbol], list[str], bool]


def blanked(text: str, pattern: str) -> str:
    """``text`` with all matches turned into spaces, line ends kept."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


PY_TEXT = r"\"\"\".*?(?:\"\"\"|(?=\Z))|'''.*?(?:'''|(?=\Z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|#[^\n]*"
C_TEXT = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?"
GO_TEXT = C_TEXT + r"|`[^`]*(?:`|\Z)|'(?:\\.|[^'\\\n])'"
RS_TEXT = r"r(#*)\".*?(?:\"\1|\Z)|" + r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\[^\n]{1,8}?|[^'\\\n])'"
TS_TEXT = C_TEXT + r"|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*(?:`|\Z)"


def python(text: str) -> Parsed:
    """Classes, functions and methods by indentation; anything nested is a method."""
    code = blanked(text, PY_TEXT)
    lines, at = [], 0
    for line, raw in zip(code.split("\n"), text.split("\n"), strict=True):
        lines.append((at, len(line) - len(line.lstrip()), line.strip(), at + len(raw.rstrip()) if raw.strip() else 0))
        at += len(line) + 1
    found, stack = [], []  # stack: (indent, id)
    for i, (start, indent, body, end) in enumerate(lines):
        m = re.match(r"(?:async\s+)?(def|class)\s+([^\W\d]\w*)", body)
        if not m:
            continue
        while stack and stack[-1][0] >= indent:
            stack.pop()
        ident = (stack[-1][1] + "." if stack else "") + m[2]
        stop = end
        for _, deeper, text_, e in lines[i + 1 :]:
            if text_ and deeper <= indent and not text_.startswith((")", "]", "}")):
                break
            stop = max(stop, e)
        kind = "class" if m[1] == "class" else "method" if stack else "function"
        found.append(Symbol(ident, kind, m[2], start + indent, stop))
        stack.append((indent, ident))
    imports = []
    for m in re.finditer(r"^[ \t]*(?:from\s+([.\w]+)\s+import\b|import\s+([^\n;]+))", code, re.M):
        imports += [m[1]] if m[1] else [p.split()[0] for p in m[2].split(",") if p.split()]
    return found, imports, _unbalanced(code)


def _unbalanced(code: str) -> bool:
    return any(code.count(a) != code.count(b) for a, b in ("()", "[]", "{}"))


def block_end(code: str, at: int) -> int:
    """The end of the block whose first brace follows ``at``; of a declaration without one, its semicolon or line."""
    m = re.compile(r"[{;]").search(code, at)
    if not m or m[0] == ";":
        return m.end() if m else len(code)
    depth = 0
    for b in re.compile(r"[{}]").finditer(code, m.start()):
        depth += 1 if b[0] == "{" else -1
        if not depth:
            return b.end()
    return len(code.rstrip())


def depths(code: str) -> Callable[[int], int]:
    """Brace depth at a place."""
    marks = [m.start() for m in re.finditer("[{}]", code)]
    sums = [0, *accumulate(1 if code[m] == "{" else -1 for m in marks)]
    return lambda at: sums[bisect_left(marks, at)]


def go(text: str) -> Parsed:
    """Top-level functions, methods and types; the types of one declaration share its range."""
    code, found = blanked(text, GO_TEXT), []
    depth = depths(code)
    for m in re.finditer(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\))?\s*(\w+)", code, re.M):
        if depth(m.start()) == 0:
            ident = f"{m[1]}.{m[2]}" if m[1] else m[2]
            found.append(Symbol(ident, "method" if m[1] else "function", m[2], m.start(), block_end(code, m.end())))
    for m in re.finditer(r"^type\s*(\()?", code, re.M):
        if m[1]:
            end = code.find("\n)", m.end())
            end = len(code) if end < 0 else end + 2
            specs = [(x[1], x[2]) for x in re.finditer(r"^[ \t]+(\w+)(?:\[[^\]]*\])?\s+=?\s*(\w+)", code[m.end() : end], re.M) if depth(m.end() + x.start()) == 0]
        else:
            x = re.compile(r"(\w+)(?:\[[^\]]*\])?\s+=?\s*(\w*)").match(code, m.end())
            specs = [(x[1], x[2])] if x else []
            line = code.find("\n", m.end())
            end = block_end(code, m.end()) if "{" in code[m.end() : line if line >= 0 else None] else (line if line >= 0 else len(code))
        found += [Symbol(n, k if k in ("struct", "interface") else "type", n, m.start(), end) for n, k in specs]
    imports = []
    bare = blanked(text, r"//[^\n]*|/\*.*?(?:\*/|\Z)")
    for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|([^\n]*))", bare, re.M):
        imports += re.findall(r'"([^"\n]+)"', m[1] or m[2] or "")
    return sorted(found, key=lambda s: s.start), imports, _unbalanced(code)


def rust(text: str) -> Parsed:
    """Functions, structs, enums, traits, and methods of impls and traits; inline modules are prefixes."""
    code, found, imports = blanked(text, RS_TEXT), [], []
    head = re.compile(r"\b(?:(fn)\s+(\w+)|(struct|enum|trait|mod)\s+(\w+)|(impl)\b(?:\s*<[^{;]*?>(?=\s))?([^{;]*))")
    scopes: list[tuple[int, str, bool]] = []  # end, prefix, holds methods
    for m in head.finditer(code):
        scopes = [s for s in scopes if s[0] > m.start()]
        inside = [s for s in scopes if s[1] == "\0"]
        prefix = "".join(s[1] for s in scopes)
        if inside:  # in the body of a function
            continue
        end = block_end(code, m.end())
        body = "{" in code[m.end() : end]
        if m[1]:
            method = bool(scopes) and scopes[-1][2]
            found.append(Symbol(prefix + m[2], "method" if method else "function", m[2], m.start(), end))
            if body:
                scopes.append((end, "\0", False))
        elif m[5]:
            target = re.split(r"\bfor\b", m[6])[-1].strip()
            name = re.match(r"[&\s]*(?:\w+::)*(\w+)", re.split(r"\bwhere\b", target)[0])
            scopes.append((end, (name[1] if name else "") + ".", True))
        elif m[3] == "mod":
            if body:
                scopes.append((end, m[4] + ".", False))
            else:
                imports.append("mod:" + m[4])
        else:
            found.append(Symbol(prefix + m[4], m[3], m[4], m.start(), end))
            if m[3] == "trait":
                scopes.append((end, m[4] + ".", True))
    uses = [" ".join(m[1].split()) for m in re.finditer(r"\buse\s+([^;]+);", code)]
    return found, uses + imports, _unbalanced(code)


NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "new", "super", "typeof", "await", "constructor?"}


def typescript(text: str) -> Parsed:
    """Functions, classes, interfaces, and their methods and method signatures."""
    code, found = blanked(text, TS_TEXT), []
    depth = depths(code)
    for m in re.finditer(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface)\b\s*\*?\s*(\w+)", code, re.M):
        if depth(m.start()):
            continue
        start = m.start(1)
        end = block_end(code, m.end())
        found.append(Symbol(m[2], m[1], m[2], start, end))
        if m[1] != "function" and (at := code.find("{", m.end())) >= 0:
            for x in re.compile(r"(?:^|[{;}])[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|abstract|override)\s+)*([\w$#]+)\??\s*(?:<[^>(]*>)?\(", re.M).finditer(code, at, end):
                if depth(x.start(1)) == depth(at) + 1 and x[1] not in NOT_NAMES:
                    stop = re.compile(r"[{;\n]").search(code, code.find(")", x.end()) if code.find(")", x.end()) >= 0 else x.end())
                    close = block_end(code, x.end()) if stop and stop[0] == "{" else stop.start() if stop else end
                    found.append(Symbol(f"{m[2]}.{x[1]}", "method", x[1], x.start(1), min(close, end)))
    bare = blanked(text, r"//[^\n]*|/\*.*?(?:\*/|\Z)")
    imports = [m[1] or m[2] or m[3] for m in re.finditer(r"""\b(?:import|export)\b[^'"\n;]*?\bfrom\s*['"]([^'"\n]+)['"]|\bimport\s*['"]([^'"\n]+)['"]|\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""", bare)]
    return found, imports, _unbalanced(code)


def slugify(title: str) -> str:
    s = re.sub(r"\s+", "-", unicodedata.normalize("NFC", title).lower().strip())
    s = "".join(c for c in s if c in "-_" or unicodedata.category(c)[0] in "LN")
    return re.sub("-+", "-", s).strip("-") or "section"


def numbered(slugs: list[str]) -> list[str]:
    """Slugs with -2, -3 ... for repeats, in order."""
    seen: dict[str, int] = {}
    out = []
    for s in slugs:
        seen[s] = seen.get(s, 0) + 1
        out.append(s if seen[s] == 1 else f"{s}-{seen[s]}")
    return out


def markdown(text: str) -> Parsed:
    """ATX headings with a text outside fences, indented ones too; a section runs to the next heading of its level or above."""
    heads, at, fenced = [], 0, False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(r"\s*(#{1,6})\s(.*)", line, re.S)) and (title := m[2].strip().rstrip("#").strip()):
            heads.append((len(m[1]), title, at))
        at += len(line) + 1
    ids = numbered([slugify(t) for _, t, _ in heads])
    out = []
    for i, (level, title, start) in enumerate(heads):
        end = next((s for lv, _, s in heads[i + 1 :] if lv <= level), len(text))
        out.append(Symbol(ids[i], "heading", title, start, end))
    return out, [], False


def underlined(text: str) -> Parsed:
    """Titles with a line of one punctuation character, as long as the title at least, below them."""
    lines, at, heads = text.split("\n"), 0, []
    for i, line in enumerate(lines[:-1]):
        under, title = lines[i + 1].rstrip(), line.strip()
        if title and re.fullmatch(r"([=\-~^\"'#*+.:_])\1*", under) and len(under) >= len(title) and not re.fullmatch(r"([=\-~^\"'#*+.:_])\1*", title):
            heads.append((title, at, at + len(line) + 1 + len(lines[i + 1]) + (i + 2 < len(lines))))
        at += len(line) + 1
    ids = numbered([slugify(t) for t, *_ in heads])
    return [Symbol(i, "heading", t, s, e) for i, (t, s, e) in zip(ids, heads, strict=True)], [], False


def _tree(text: str, load: Callable[[str], object], kinds: Callable[[object], str], sort: bool) -> Parsed:
    """Every key and element as a JSON pointer; the root has none."""
    try:
        root = load(text)
    except Exception:  # noqa: BLE001  each format has errors of its own
        return [], [], True
    out = []

    def walk(value: object, pointer: str) -> None:
        items = sorted(value.items()) if isinstance(value, dict) and sort else value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in items:
            key = ("true" if k else "false") if isinstance(k, bool) else "null" if k is None else str(k)
            inner = f"{pointer}/{key.replace('~', '~0').replace('/', '~1')}"
            out.append(Symbol(inner, kinds(v), key, 0, len(text), json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=str, sort_keys=sort)))
            walk(v, inner)

    walk(root, "")
    return out, [], False


def _kinds(table: str, array: str) -> Callable[[object], str]:
    def kind(v: object) -> str:
        if isinstance(v, dict):
            return table
        if isinstance(v, list):
            return array
        if isinstance(v, bool):
            return "boolean"
        if v is None:
            return "null"
        return "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "datetime"

    return kind


def json_file(text: str) -> Parsed:
    return _tree(text, json.loads, _kinds("object", "array"), sort=True)


#: Of these characters, and not nested deep, libyaml reads the same as the Python loader; of others it may not.
PLAIN, DEEP = re.compile(r"[A-Za-z0-9_./ \n:-]*"), re.compile(r"^[ -]{60}", re.M)


def _yaml(text: str) -> object:
    """What ``yaml.safe_load`` gives, by libyaml if that is there and plain texts allow it."""
    fast = getattr(yaml, "CSafeLoader", None)
    return yaml.load(text, fast) if fast and PLAIN.fullmatch(text) and not DEEP.search(text) else yaml.safe_load(text)


def yaml_file(text: str) -> Parsed:
    return _tree(text, _yaml, _kinds("mapping", "sequence"), sort=False)


def toml_file(text: str) -> Parsed:
    return _tree(text, tomllib.loads, _kinds("table", "array"), sort=True)


def csv_file(text: str) -> Parsed:
    """The columns that the first line names."""
    line = text.removeprefix("\ufeff").split("\n", 1)[0]
    names = [n for n in (x.strip().strip('"') for x in line.split(",")) if n]
    return [Symbol(n, "column", n, 0, len(line)) for n in names], [], False


def notebook(text: str) -> Parsed:
    """Code cells as one Python text, markdown cells as one markdown text."""
    try:
        cells = json.loads(text)["cells"]
        text_of = lambda c: c["source"] if isinstance(c["source"], str) else "".join(c["source"])
        code = "\n".join(text_of(c) for c in cells if c.get("cell_type") == "code")
        prose = "\n".join(text_of(c) for c in cells if c.get("cell_type") == "markdown")
    except (ValueError, KeyError, TypeError):
        return [], [], True
    a, imports, partial = python(code)
    b, _, _ = markdown(prose)
    return [s._replace(source=code[s.start : s.end]) for s in a] + [s._replace(source=prose[s.start : s.end]) for s in b], imports, partial


PARSERS: dict[str, Callable[[str], Parsed]] = {
    "py": python, "go": go, "rs": rust, "ts": typescript, "md": markdown, "rst": underlined, "txt": underlined, "json": json_file,
    "yaml": yaml_file, "yml": yaml_file, "toml": toml_file, "csv": csv_file, "ipynb": notebook,
}


def register(ext: str, parser: Callable[[str], Parsed]) -> None:
    """Adds or replaces the parser of an extension."""
    PARSERS[ext] = parser


SYMBOLS = "path string, seq int, id string, node_type string, name string, start long, end long, source string"


def _each(content: DataFrame, row: Callable[[str, int, Symbol | str, str], tuple], part: int, schema: str, most: int) -> DataFrame:
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                parser = parsers.get(path.rsplit(".", 1)[-1].lower())
                if parser and text is not None and len(text.encode()) <= most:
                    rows += [row(path, i, x, text) for i, x in enumerate(parser(text)[part])]
            yield pd.DataFrame(rows, columns=columns)

    return content.select("path", "text").mapInPandas(run, schema)


def symbols(content: DataFrame, most: int = 5 << 20) -> DataFrame:
    """The symbol table of (path, text), with byte ranges and sketches."""

    def row(path: str, i: int, s: Symbol, text: str) -> tuple:
        start = len(text[: s.start].encode())
        return path, i, s.id, s.node_type, s.name, start, start + len(text[s.start : s.end].encode()), s.source if s.source is not None else text[s.start : s.end]

    return _each(content, row, 0, SYMBOLS, most).withColumn("sketch", sketch(F.col("source")))


def imports(content: DataFrame, most: int = 5 << 20) -> DataFrame:
    """(path, seq, spec) of the raw imports."""
    return _each(content, lambda path, i, spec, _: (path, i, spec), 1, "path string, seq int, spec string", most)


def docstrings(content: DataFrame, most: int = 5 << 20) -> DataFrame:
    """(path, text) of the docstrings of Python modules, classes and functions."""
    found = r"(?s)(?:^|(?:def|class)\s[^\n]*:[ \t]*)(?:\s|#[^\n]*\n)*[rRuU]?(?:\"{3}(.*?)\"{3}|'{3}(.*?)'{3})"
    few = content.filter(F.col("path").endswith(".py") & (F.octet_length("text") <= most))
    each = lambda group: few.select("path", F.explode(F.regexp_extract_all("text", F.lit(found), F.lit(group))).alias("text")).filter("text != ''")
    return each(1).union(each(2))


def calls(content: DataFrame, most: int = 5 << 20) -> DataFrame:
    """(path, kind, token) of the calls in Python files: bare names, names of ``self``, other attributes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                for m in re.finditer(r"(?:\b(self\.)|(\.))?\b([^\W\d]\w*)\s*\(", blanked(text, PY_TEXT)):
                    if m[1] or m[2] or not (m[3] in KEYWORDS or re.search(r"\b(?:def|class)\s+$", m.string[: m.start()][-20:])):
                        rows.append((path, "self" if m[1] else "attr" if m[2] else "bare", m[3]))
            yield pd.DataFrame(rows, columns=["path", "kind", "token"])

    few = content.filter(F.col("path").endswith(".py") & (F.octet_length("text") <= most))
    return few.select("path", "text").mapInPandas(run, "path string, kind string, token string")


KEYWORDS = set(keyword.kwlist)


def frontmatter(text: str) -> list[tuple[str, str]]:
    """Ordered (key, value) pairs of a leading block between lines of three dashes."""
    m = re.match(r"---\r?\n(.*?)\r?\n---(?:\r?\n|\Z)", text, re.S)
    return [(k.strip(), v.strip()) for k, s, v in (line.partition(":") for line in (m[1].split("\n") if m else [])) if s and k.strip()]
