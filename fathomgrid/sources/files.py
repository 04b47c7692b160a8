"""Trees of files as tables: scan, content, snapshots, record logs, settings, renames."""

from __future__ import annotations

import io
import json
import os
import subprocess
import tarfile
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.sources import ignore

#: Folders that are never scanned, and patterns that are ignored by default.  Fixed values.
NEVER = {".git", ".vault", ".vault-ai"}
DEFAULT_PATTERNS = ["vendor/", "third_party/", "deps/", "node_modules/", "target/", "dist/", "build/", ".venv/", "__pycache__/"]
CONTENT_BYTES, PARSE_BYTES, SNIFF = 1 << 20, 5 << 20, 8192
FILES = "path string, filename string, ext string, size long, mtime_ns long"
LINKS = "id string, op string, `from` string, rel string, `to` string, origin string, confidence string, ts string"
DECISIONS = "key string, verdict string, rule string, `from` string, `to` string, ts string"
PENDING = "id string, rule string, agent string, `from` string, rel string, `to` string, rationale string, ts string, status string"
ALIASES = "kind string, `from` string, `to` string, source string, confidence string, ts string, commit string"


@dataclass
class Settings:
    """The settings file of a tree; unknown keys are kept."""

    name: str = ""
    schema_version: int = 1
    use_gitignore: bool = True
    patterns: list[str] = field(default_factory=lambda: list(DEFAULT_PATTERNS))
    content_bytes: int = CONTENT_BYTES
    parse_bytes: int = PARSE_BYTES
    write_mode: str = "pending"
    other: dict = field(default_factory=dict)

    @classmethod
    def read(cls, root: str) -> Settings:
        """Defaults if there is no file; a malformed one is an error."""
        path = Path(root, ".vault", "vault.toml")
        if not path.exists():
            return cls()
        d = tomllib.loads(path.read_text("utf-8"))
        v, i, n, m = (dict(d.pop(k, {})) for k in ("vault", "ignore", "limits", "mcp"))
        new = cls()
        return cls(v.get("name", ""), v.get("schema_version", 1), i.get("use_gitignore", True), i.get("patterns", new.patterns), n.get("content_bytes", CONTENT_BYTES), n.get("parse_bytes", PARSE_BYTES), m.get("write_mode", "pending"), d)

    def write(self, root: str) -> None:
        s = json.dumps
        text = f"[vault]\nname = {s(self.name)}\nschema_version = {self.schema_version}\n\n[ignore]\nuse_gitignore = {s(self.use_gitignore)}\npatterns = {s(self.patterns)}\n\n[limits]\ncontent_bytes = {self.content_bytes}\nparse_bytes = {self.parse_bytes}\n\n[mcp]\nwrite_mode = {s(self.write_mode)}\n"
        for table, values in self.other.items():
            text += f"\n[{table}]\n" + "".join(f"{k} = {s(v)}\n" for k, v in values.items()) if isinstance(values, dict) else ""
        path = Path(root, ".vault", "vault.toml")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, "utf-8")


def walk(root: str, use_gitignore: bool = True, patterns: list[str] | None = None) -> Iterator[tuple[str, os.stat_result]]:
    """(relative path, stat) of the files of a tree; dot files count, ignored and unreadable ones don't."""
    extra = ignore.rules("\n".join(patterns or []))

    def inner(folder: str, stack: list[ignore.Rule]) -> Iterator[tuple[str, os.stat_result]]:
        at = os.path.join(root, folder)
        if use_gitignore:
            for name in (".gitignore", ".ignore"):
                try:
                    stack = stack + ignore.rules(Path(at, name).read_text("utf-8", "replace"), folder)
                except OSError:
                    continue
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_folder = e.is_dir(follow_symlinks=False)
            if e.name in NEVER or ignore.ignored(path, is_folder, stack) or ignore.ignored(path, is_folder, extra):
                continue
            if is_folder:
                yield from inner(path, stack)
            elif e.is_file(follow_symlinks=False):
                try:
                    yield path, e.stat(follow_symlinks=False)
                except OSError:
                    continue

    yield from inner("", [])


def scan(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """The file table of a tree: path, filename, ext, size, mtime_ns."""
    s = settings or Settings.read(root)
    rows = [(p, p.rsplit("/", 1)[-1], os.path.splitext(p)[1][1:].lower(), st.st_size, st.st_mtime_ns) for p, st in walk(root, s.use_gitignore, s.patterns)]
    return spark.createDataFrame(rows, FILES)


def content(spark: SparkSession, root: str, files: DataFrame, most: int = CONTENT_BYTES) -> DataFrame:
    """(path, text) of the files of UTF-8 text of at most ``most`` bytes without NUL in their first 8192 bytes."""

    def load(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            texts = []
            for p in pdf["path"]:
                try:
                    texts.append(Path(root, p).read_bytes())
                except OSError:
                    texts.append(None)
            yield pdf.assign(bytes=texts)[["path", "bytes"]]

    raw = files.filter(F.col("size") <= most).select("path").mapInPandas(load, "path string, bytes binary")
    head = F.decode(F.substring("bytes", 1, SNIFF), "ISO-8859-1")
    return raw.filter(F.col("bytes").isNotNull()).filter(~head.contains("\x00")).filter(F.is_valid_utf8(F.col("bytes").cast("string"))).select("path", F.col("bytes").cast("string").alias("text"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines without its header; a missing file is empty, a malformed line an error."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    lines = spark.read.schema(schema + ", _type string").option("mode", "FAILFAST").json(path)
    return lines.filter("_type is null").drop("_type")


def append(path: str, kind: str, record: dict) -> None:
    """Adds a record to a log; the first one writes the header."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    new = not os.path.exists(path)
    with open(path, "a", encoding="utf-8") as f:
        if new:
            f.write(json.dumps({"_type": kind, "_v": 1}) + "\n")
        f.write(json.dumps(record, ensure_ascii=False) + "\n")


def replace(path: str, kind: str, rows: DataFrame) -> None:
    """Writes a log anew, row by row as they come; for the small logs that live beside a tree."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    new = f"{path}.new"  # the rows may come from the log itself
    with open(new, "w", encoding="utf-8") as f:
        f.write(json.dumps({"_type": kind, "_v": 1}) + "\n")
        for line in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            f.write(line.j + "\n")
    os.replace(new, path)


def rename_events(text: str) -> list[tuple[int, str, str, str, str]]:
    """(seq, old, new, commit, ts) from a log in the format ``commit\\t%H\\t%cI`` with name statuses."""
    out, commit, ts = [], "", ""
    for line in text.splitlines():
        parts = line.split("\t")
        if parts[0] == "commit" and len(parts) == 3:
            commit, ts = parts[1], parts[2]
        elif parts[0].startswith("R") and len(parts) == 3:
            out.append((len(out), parts[1], parts[2], commit, ts))
    return out


def renames(spark: SparkSession, root: str) -> DataFrame:
    """Rename events of the git history of a tree, newest first; empty without a history."""
    run = subprocess.run(["git", "-C", root, "log", "--all", "--diff-filter=R", "--name-status", "-M", "--format=commit\t%H\t%cI"], capture_output=True, text=True, check=False)
    return spark.createDataFrame(rename_events(run.stdout if run.returncode == 0 else ""), "seq long, old string, new string, commit string, ts string")


def commits(spark: SparkSession, root: str, most: int = 8000) -> DataFrame:
    """(commit, file) of the last commits without merges."""
    run = subprocess.run(["git", "-C", root, "log", f"-{most}", "--name-only", "--no-merges", "--format=commit\t%H"], capture_output=True, text=True, check=False)
    rows, commit = [], ""
    for line in run.stdout.splitlines():
        if line.startswith("commit\t"):
            commit = line.split("\t")[1]
        elif line:
            rows.append((commit, line))
    return spark.createDataFrame(rows, "commit string, file string")


def at_revision(spark: SparkSession, root: str, rev: str = "HEAD", glob: str = "*.py") -> DataFrame:
    """(path, text) of the files of a revision in the git history of a tree; empty without one."""
    run = subprocess.run(["git", "-C", root, "archive", "--format=tar", rev, "--", glob], capture_output=True, check=False)
    rows = []
    if run.returncode == 0:
        with tarfile.open(fileobj=io.BytesIO(run.stdout)) as tar:
            for m in tar.getmembers():
                if m.isfile() and (f := tar.extractfile(m)):
                    rows.append((m.name, f.read().decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "path string, text string")


def deleted(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files that some commit deleted."""
    run = subprocess.run(["git", "-C", root, "log", "--all", "--diff-filter=D", "--name-only", "--format="], capture_output=True, text=True, check=False)
    return spark.createDataFrame([(x,) for x in sorted(set(run.stdout.split("\n"))) if x], "path string")
