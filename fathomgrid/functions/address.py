"""Addresses of files and of places in them: ``vault://path#fragment``."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEME = "vault://"
#: Prefixes of typed fragments, and what they address.  Fixed values of the format.
KINDS = {"h:": "heading", "row:": "row", "col:": "column", "cell:": "cell"}


def encode(segment: Column, symbol: bool = False) -> Column:
    """Escapes ``%``, ``#``, ``/`` and control characters, and ``.`` in symbol names."""
    out = F.replace(segment, F.lit("%"), F.lit("%25"))
    for c in "#/" + ("." if symbol else "") + "".join(map(chr, range(32))):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def decode_text(s: str) -> str:
    """Undoes %XX; bytes that are not UTF-8 become replacement characters."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), s.encode())
    return raw.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else decode_text(x))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def path_error(path: Column) -> Column:
    """Why a path is refused, or null: EmptyPath, AbsolutePath, ParentTraversal."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p == "", "EmptyPath").when(p.startswith("/") | p.rlike("^.:"), "AbsolutePath").when(F.array_contains(F.split(p, "/"), ".."), "ParentTraversal")


def fragment_kind(fragment: Column) -> Column:
    out = F.when(fragment.startswith("/"), "pointer")
    for prefix, kind in KINDS.items():
        out = out.when(fragment.startswith(prefix), kind)
    return out.otherwise("symbol")


def parse(uri: Column) -> Column:
    """Struct (path, kind, value, parts, error) of an address; path and values still escaped, errors named."""
    rest = F.substring(uri, len(SCHEME) + 1, 1 << 30)
    has = F.instr(rest, "#") > 0
    path = F.when(has, F.substring_index(rest, "#", 1)).otherwise(rest)
    fragment = F.when(has, F.regexp_extract(rest, "(?s)^[^#]*#(.*)$", 1))
    kind = F.when(fragment.isNull(), "file").otherwise(fragment_kind(fragment))
    value = F.when(fragment.isNull(), None).otherwise(F.regexp_replace(fragment, "^(h:|row:|col:|cell:)", ""))
    parts = F.when(kind == "symbol", F.split(value, r"\."))
    empty = fragment.isNotNull() & ((fragment == "") | ((value == "") & (kind != "pointer")))
    error = F.when(~uri.startswith(SCHEME), "MissingScheme").when(path_error(path).isNotNull(), path_error(path)).when(empty, "EmptyFragment")
    return F.struct(path.alias("path"), kind.alias("kind"), value.alias("value"), parts.alias("parts"), error.alias("error"))


def symbol_address(path: Column, node_type: Column, ident: Column) -> Column:
    """The address of a symbol: pointers as they are, ``h:``/``col:`` by type, dotted names escaped by segment."""
    dotted = F.array_join(F.transform(F.split(ident, r"\."), lambda s: encode(s, symbol=True)), ".")
    fragment = F.when(ident.startswith("/"), ident).when(node_type == "heading", F.concat(F.lit("h:"), encode(ident))).when(node_type == "column", F.concat(F.lit("col:"), encode(ident))).otherwise(dotted)
    return F.concat(F.lit(SCHEME), path, F.lit("#"), fragment)
