"""Column builders for text: tokens, tags, slugs, shingles, previews.  All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{IsAlphabetic}\p{N}]+)"
NO_MAX = 4294967295  # pads a sketch that has fewer values


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; ``_`` separates."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), lambda t: F.lower(t))


def tags(text: Column) -> Column:
    """Sorted distinct ``#tag`` names: ASCII word characters, ``/`` and ``-``, not after a word character."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])#([A-Za-z0-9_/\-]+)"), F.lit(1))))


def slug(title: Column) -> Column:
    """Heading slug: lower case, white space to ``-``, letters, digits, ``_`` and ``-`` only; ``section`` if nothing is left."""
    s = F.regexp_replace(F.trim(F.lower(title)), r"\s+", "-")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\-_]", "")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.when(s == "", "section").otherwise(s)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(words: Column, k: int) -> Column:
    """Runs of k words joined by a space; of fewer words, none."""

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w) - k + 1, F.lit(0))
        out = F.slice(w, F.lit(1), n)
        for i in range(2, k + 1):
            out = F.zip_with(out, F.slice(w, F.lit(i), n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.coalesce(out, F.array().cast("array<string>"))

    return let(words, of)


def sketch(source: Column, k: int = 3, size: int = 32) -> Column:
    """The ``size`` least distinct crc32 values of the 3-grams of ``[alnum_]+`` tokens, padded; fewer tokens: the source's own crc32."""
    words = F.regexp_extract_all(source, F.lit(r"([\p{IsAlphabetic}\p{N}_]+)"), F.lit(1))
    few = F.array(F.crc32(source.cast("binary")))
    of = let(words, lambda w: F.when(F.size(w) < k, few).otherwise(F.transform(shingles(w, k), lambda g: F.crc32(g.cast("binary")))))
    least = F.slice(F.array_sort(F.array_distinct(of)), 1, size)
    return let(least, lambda v: F.concat(v, F.array_repeat(F.lit(NO_MAX).cast("long"), F.lit(size) - F.size(v))))


def preview(text: Column, n: int = 200) -> Column:
    """The first n characters after leading white space, with an ellipsis if more follow."""
    t = F.regexp_replace(text, r"^\s+", "")
    return F.concat(F.substring(t, 1, n), F.when(F.length(t) > n, "…").otherwise(""))


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines start to end, from 1 and inclusive, clamped to the text."""
    lines = F.split(text, "\n")
    first = max(1, start)
    return F.array_join(F.slice(lines, first, max(0, end - first + 1)), "\n")


def byte_span(text: Column, start: Column, end: Column) -> Column:
    """The text at UTF-8 bytes [start, end)."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def pointer_escape(key: Column) -> Column:
    """A key as a token of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def inline_code(line: Column) -> Column:
    """Tokens between pairs of backticks without white space in them."""
    return F.filter(F.regexp_extract_all(line, F.lit("`([^`]*)`"), F.lit(1)), lambda t: (t != "") & ~t.rlike(r"\s"))


def compound(token: Column) -> Column:
    """Whether a token is an identifier rather than a word: ``_``, a digit, or a capital after the first letter."""
    return token.rlike("[_0-9]") | token.rlike(r"^.+\p{Lu}")


def decision_key(rule: Column, source: Column, target: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of rule, source and target on lines of their own."""
    return F.substring(F.sha2(F.concat_ws("\n", rule, source, target), 256), 1, 16)


def plausible_path(value: Column) -> Column:
    """Whether a string may be a relative path."""
    return (value != "") & (F.octet_length(value) < 300) & ~value.contains("://") & ~value.startswith("/") & ~F.coalesce(value.rlike("^.:"), F.lit(False)) & ~value.contains("\x00")


def looks_like_identifier(token: Column) -> Column:
    """Four characters or more with ``_``, inner capitals, a capital start from five, or eight at least."""
    shape = token.contains("_") | token.rlike("[a-z][A-Z]") | token.rlike("^[A-Z].{4,}") | (F.length(token) >= 8)
    return (F.length(token) >= 4) & shape


def varint_bytes(value: Column) -> Column:
    """Length of a number in groups of seven bits."""
    out = F.lit(1)
    for i in range(1, 9):
        out = out + F.when(value >= F.lit(1 << (7 * i)), 1).otherwise(0)
    return out
