import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomgrid.functions import address, text
from fathomgrid.sources import parsers


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_tokens_split_on_underscores(spark):
    assert one(spark, text.tokens(F.col("x")), "Parse_Router: é2, ok") == ["parse", "router", "é2", "ok"]


def test_tags(spark):
    x = "# Heading is not a tag\nSee #project/alpha and #urgent, but not foo#bar mid-word. ##twice"
    assert one(spark, text.tags(F.col("x")), x) == ["project/alpha", "twice", "urgent"]


@pytest.mark.parametrize(("title", "slug"), [("Teacher Router", "teacher-router"), ("주소 체계", "주소-체계"), ("`vault://` 문법", "vault-문법"), ("3. 해석 계단!", "3-해석-계단"), ("---", "section")])
def test_slugs(spark, title, slug):
    assert one(spark, text.slug(F.col("x")), title) == slug == parsers.slugify(title)


def test_repeated_slugs():
    assert parsers.numbered(["addr", "addr", "other", "addr"]) == ["addr", "addr-2", "other", "addr-3"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_slugify_is_idempotent(x):
    assert parsers.slugify(parsers.slugify(x)) == parsers.slugify(x)


@pytest.mark.parametrize(
    ("uri", "kind", "value", "error"),
    [
        ("vault://a/b.py", "file", None, None),
        ("vault://r.py#TeacherRouter.select", "symbol", "TeacherRouter.select", None),
        ("vault://a.md#h:intro", "heading", "intro", None),
        ("vault://a.json#/a/b", "pointer", "/a/b", None),
        ("vault://a.csv#col:name", "column", "name", None),
        ("vault://a.csv#row:3", "row", "3", None),
        ("vault://a.csv#cell:3,name", "cell", "3,name", None),
        ("vault://a.md#h:", "heading", "", "EmptyFragment"),
        ("vault://a.md#", "symbol", "", "EmptyFragment"),
        ("a.md", "file", None, "MissingScheme"),
        ("vault:///etc", "file", None, "AbsolutePath"),
        ("vault://C:/x", "file", None, "AbsolutePath"),
        ("vault://a/../b", "file", None, "ParentTraversal"),
        ("vault://", "file", None, "EmptyPath"),
    ],
)
def test_addresses(spark, uri, kind, value, error):
    a = one(spark, address.parse(F.col("x")), uri)
    assert a.error == error
    if not error:
        assert (a.kind, a.value) == (kind, value)


def test_parts_of_a_symbol(spark):
    a = one(spark, address.parse(F.col("x")), "vault://r.py#Config%2Eload.x")
    assert a.parts == ["Config%2Eload", "x"] and address.decode_text(a.parts[0]) == "Config.load"


def test_encode_and_decode_are_inverse(spark):
    names = ["a.b", "50%#/x", "tab\there", "é한", "%41"]
    df = spark.createDataFrame([(n,) for n in names], "x string").select("x", address.encode(F.col("x"), symbol=True).alias("e")).withColumn("d", address.decode("e"))
    for r in df.collect():
        assert r.d == r.x and not re.search(r"[#/.\x00-\x1f]", r.e)


def test_sketch_pads_and_falls_back(spark):
    s = one(spark, text.sketch(F.col("x")), "one two")
    assert len(s) == 32 and s[1:] == [text.NO_MAX] * 31
    assert len({*one(spark, text.sketch(F.col("x")), "a b c d")}) == 3


def test_preview_and_lines(spark):
    assert one(spark, text.preview(F.col("x")), "  " + "a" * 201) == "a" * 200 + "…"
    assert one(spark, text.line_range(F.col("x"), 0, 2), "a\nb\nc") == "a\nb"
    assert one(spark, text.byte_span(F.col("x"), F.lit(1), F.lit(3)), "aéb") == "é"


def test_varint(spark):
    assert [one(spark, text.varint_bytes(F.col("x")), v, "long") for v in (0, 127, 128, 16383, 16384)] == [1, 1, 2, 2, 3]


def test_identifiers(spark):
    assert [one(spark, text.compound(F.col("x")), v) for v in ("Cache", "handle_data", "TeacherRouter", "v2", "word")] == [False, True, True, True, False]
    assert [one(spark, text.plausible_path(F.col("x")), v) for v in ("a/b", "", "http://x", "/a", "C:/x")] == [True, False, False, False, False]


def test_decision_keys(spark):
    k = one(spark, text.decision_key(F.lit("R1"), F.col("x"), F.lit("b")), "a")
    assert re.fullmatch("[0-9a-f]{16}", k)
