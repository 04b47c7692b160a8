"""One tree of files, opened: search, reading, neighbours, suggestions, decisions."""

from __future__ import annotations

import base64
import fcntl
import json
import os
import secrets
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.functions import address, text
from fathomgrid.operators import fuzzy, graph, search, suggest
from fathomgrid.sources import files as src
from fathomgrid.sources import parsers

SCHEMA_VERSION = 1


def new_id(prefix: str) -> str:
    """A sortable id: 48 bits of time and 80 random ones in base 32."""
    value, digits, out = (int(time.time() * 1000) << 80) | secrets.randbits(80), "0123456789ABCDEFGHJKMNPQRSTVWXYZ", ""
    for _ in range(26):
        value, r = divmod(value, 32)
        out = digits[r] + out
    return f"{prefix}_{out}"


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z")


def relative(path: str) -> str:
    """A clean path inside the tree, or ValueError."""
    p = path.replace("\\", "/")
    if not p or p.startswith("/") or p[1:2] == ":" or ".." in p.split("/"):
        raise ValueError(f"not a path inside the tree: {path}")
    return p


class Tree:
    """The tables of a tree; call ``refresh`` after changes on disk."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        self.spark, self.root = spark, root
        self.log = lambda name: os.path.join(root, ".vault", name)
        self.refresh()

    def lock(self) -> object:
        """An exclusive lock on the tree's storage, held until the returned file is closed."""
        path = Path(self.root, ".vault-ai", "state", "lock")
        path.parent.mkdir(parents=True, exist_ok=True)
        f = path.open("w")
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        return f

    def schema_state(self) -> str:
        """FirstRun, Match or Mismatch of the stored index version; stores the current one."""
        path = Path(self.root, ".vault-ai", "state", "schema_version")
        path.parent.mkdir(parents=True, exist_ok=True)
        old = path.read_text().strip() if path.exists() else None
        path.write_text(str(SCHEMA_VERSION))
        return "FirstRun" if old is None else "Match" if old == str(SCHEMA_VERSION) else "Mismatch"

    def refresh(self) -> None:
        s = self.settings = src.Settings.read(self.root)
        self.files = src.scan(self.spark, self.root, s).cache()
        self.content = src.content(self.spark, self.root, self.files, s.content_bytes).cache()
        self.symbols = parsers.symbols(self.content, s.parse_bytes).withColumn("uri", address.symbol_address(F.col("path"), F.col("node_type"), F.col("id"))).cache()
        self.postings = search.postings(self.content, "text", "path").cache()
        self.lengths = search.lengths(self.content, "text", "path").cache()

    def derived_links(self) -> DataFrame:
        paths = self.files.select("path")
        return suggest.referenced(self.symbols, paths).unionByName(suggest.imported(parsers.imports(self.content), paths))

    def links(self) -> DataFrame:
        """(source, target, rel) of derived and live manual links."""
        derived = self.derived_links().select(F.concat(F.lit(address.SCHEME), "from").alias("source"), F.concat(F.lit(address.SCHEME), "to").alias("target"), "rel")
        manual = graph.fold(src.records(self.spark, self.log("links.jsonl"), src.LINKS)).select(F.col("from").alias("source"), F.col("to").alias("target"), "rel")
        return derived.unionByName(manual)

    def graph(self, manual_only: bool = False) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of folders, files and the links between files that exist."""
        nodes = graph.nodes(self.files.withColumn("time", F.col("mtime_ns")), "time")
        path = lambda c: F.regexp_replace(F.substring_index(c, "#", 1), "^vault://", "")
        live = self.links().select(path("source").alias("source"), path("target").alias("target"), "rel")
        ids = nodes.select("id")
        live = live.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "rel")
        return nodes, graph.contains(self.files).unionByName(live)

    def tags(self) -> DataFrame:
        each = self.content.select("path", F.explode(text.tags(F.col("text"))).alias("tag"))
        return each.groupBy("tag").agg(F.sort_array(F.collect_set("path")).alias("paths"))

    def stats(self) -> DataFrame:
        one = self.files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        return one.crossJoin(self.lengths.agg(F.count("*").alias("indexed"))).crossJoin(self.symbols.agg(F.count("*").alias("symbols")))  # single rows

    def search(self, query: str, kind: str = "auto", limit: int = 20) -> list[dict]:
        """Hits by file name, symbol and content, in this order, each address once."""
        limit = min(100, max(1, limit))
        where, terms = suggest.query_filter(query)
        rest = " ".join(terms)
        few = self.files.filter(where)
        layers: list[list[dict]] = []
        if kind in ("auto", "file"):
            rows = fuzzy.ranked(few, rest, limit).collect() if rest else few.select("path").orderBy("path").limit(limit).collect()
            layers.append([{"uri": address.SCHEME + r.path, "type": "file", "preview": ""} for r in rows])
        if kind in ("auto", "symbol") and rest:
            rows = self.symbols.filter(F.lower("id").contains(rest.lower())).join(few.select("path"), "path", "left_semi").orderBy("path", "seq").limit(limit)
            layers.append([{"uri": r.uri, "type": r.node_type, "range": [r.start, r.end], "preview": r.p} for r in rows.select("uri", "node_type", "start", "end", text.preview(F.col("source")).alias("p"), "path", "seq").collect()])
        if kind in ("auto", "text") and rest:
            words = self.spark.range(1).select(text.tokens(F.lit(rest)).alias("t")).first().t
            best = search.top(search.bm25(self.postings, self.lengths, words, "path").join(few.select("path"), "path", "left_semi"), limit, "path")
            rows = best.join(self.content, "path").select("path", "score", text.preview(F.col("text")).alias("p")).orderBy(F.desc("score"), "path").collect() if words else []
            layers.append([{"uri": address.SCHEME + r.path, "type": "text", "preview": r.p} for r in rows])
        seen: dict[str, dict] = {}
        for hit in (h for layer in layers for h in layer):
            seen.setdefault(hit["uri"], hit)
        return list(seen.values())[:limit]

    def read(self, uri: str, lines: tuple[int, int] | None = None) -> str:
        """The text of a file, of a line range, of a symbol, row or cell.  Only scanned files can be read."""
        if not uri.startswith(address.SCHEME):
            raise ValueError("MissingScheme")
        raw, _, fragment = uri[len(address.SCHEME) :].partition("#")
        path = relative(address.decode_text(raw))
        if self.files.filter(F.col("path") == path).isEmpty():
            raise PermissionError(f"not in the index: {path}")
        body = Path(self.root, path).read_text("utf-8")
        if fragment.startswith(("row:", "cell:")):
            kind, _, at = fragment.partition(":")
            rows = body.split("\n")
            number = int(at.partition(",")[0])
            cells = rows[number].split(",")
            return rows[number] if kind == "row" else cells[rows[0].split(",").index(at.partition(",")[2])]
        if fragment:
            row = self.symbols.filter((F.col("path") == path) & (F.col("uri") == uri)).first()
            if row is None:
                raise KeyError(uri)
            return row.source
        if lines:
            return "\n".join(body.split("\n")[max(0, lines[0] - 1) : lines[1]])
        return body

    def neighbors(self, uri: str, depth: int = 1, direction: str = "both", rels: list[str] | None = None, limit: int = 20) -> list[dict]:
        found = graph.neighbors(self.links(), [uri], depth, direction, rels, min(100, max(1, limit)))
        named = found.join(self.symbols.select(F.col("uri").alias("id"), "node_type"), "id", "left")
        return [{"uri": r.id, "depth": r.depth, "type": r.node_type or "file"} for r in named.orderBy("depth", "id").collect()]

    def propose_link(self, source: str, rel: str, target: str, rationale: str, agent: str = "agent") -> str:
        """Adds a pending link for review."""
        if self.settings.write_mode == "off":
            raise PermissionError("writing is off")
        record = {"id": new_id("p"), "rule": "agent", "agent": agent, "from": source, "rel": rel, "to": target, "rationale": rationale, "ts": now(), "status": "pending"}
        src.append(self.log("pending.jsonl"), "pending", record)
        return record["id"]

    def suggestions(self, dictionary: DataFrame | None = None) -> DataFrame:
        decisions = src.records(self.spark, self.log("decisions.jsonl"), src.DECISIONS)
        return suggest.undecided(suggest.described(self.content, self.symbols, dictionary), decisions)

    def decide(self, source: str, target: str, accept: bool, rule: str = "R1") -> None:
        """Records a decision; accepting adds a manual link."""
        key = self.spark.range(1).select(text.decision_key(F.lit(rule), F.lit(source), F.lit(target)).alias("k")).first().k
        src.append(self.log("decisions.jsonl"), "decisions", {"key": key, "verdict": "accept" if accept else "reject", "rule": rule, "from": source, "to": target, "ts": now()})
        if accept:
            src.append(self.log("links.jsonl"), "links", {"id": new_id("l"), "op": "add", "from": address.SCHEME + source, "rel": "describes", "to": address.SCHEME + target, "origin": "manual", "confidence": "certain", "ts": now()})

    def open_file(self, path: str) -> dict:
        body = Path(self.root, relative(path)).read_text("utf-8")
        return {"content": body, "frontmatter": parsers.frontmatter(body)}

    def read_base64(self, path: str) -> str:
        return base64.b64encode(Path(self.root, relative(path)).read_bytes()).decode()

    def save_file(self, path: str, body: str) -> None:
        at = Path(self.root, relative(path))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body, "utf-8")

    def list_files(self) -> list[str]:
        return [r.path for r in self.files.select("path").orderBy("path").collect()]


TOOLS = {
    "vault_search": ("search", ["query", "kind", "limit"]),
    "vault_read": ("read", ["uri", "lines"]),
    "vault_neighbors": ("neighbors", ["uri", "depth", "direction", "rels", "limit"]),
    "vault_propose_link": ("propose_link", ["source", "rel", "target", "rationale", "agent"]),
}


def answer(tree: Tree, line: str) -> str | None:
    """The reply to one JSON-RPC line; notifications have none."""
    try:
        call = json.loads(line)
    except ValueError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
    if "id" not in call:
        return None
    method, params = call.get("method"), call.get("params") or {}
    if method == "initialize":
        result: dict = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "fathomgrid", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {a: {} for a in args}}} for n, (_, args) in TOOLS.items()]}
    elif method == "tools/call" and params.get("name") in TOOLS:
        name, args = TOOLS[params["name"]]
        try:
            out = getattr(tree, name)(**{k: v for k, v in (params.get("arguments") or {}).items() if k in args})
            shown = "No results." if out == [] else out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=1)
            result = {"content": [{"type": "text", "text": shown}]}
        except Exception as e:  # noqa: BLE001  a tool's failure is an answer
            result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
    else:
        return json.dumps({"jsonrpc": "2.0", "id": call["id"], "error": {"code": -32601, "message": "method not found"}})
    return json.dumps({"jsonrpc": "2.0", "id": call["id"], "result": result}, ensure_ascii=False)
