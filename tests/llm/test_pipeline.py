import os

import corpus_pipeline
import pytest
from fathomgrid.llm.base import keyed, shared_folder
from fathomgrid.llm.minhash import grouped
from pyspark.sql import functions as F
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    item = prose(5000, 45)
    rows = [(i, prose(i, 80 + i)) for i in range(60)]
    rows += [(100 + i, prose(1, 81)) for i in range(5)]  # copies of document 1
    w = prose(2, 82).split()
    rows += [(200, " ".join([*w[:40], "changed", *w[41:]]))]  # near copy of document 2
    rows += [(300, prose(900, 60) + " " + item + " " + prose(901, 60))]  # leaks an item
    rows += [(400, "junk " * 200), (401, None), (402, "")]
    rows += [(500 + i, prose(700 + i, 60) + "\nAll rights reserved by us\n" + prose(800 + i, 60)) for i in range(15)]
    docs = spark.createDataFrame([(i, t, "en", ["a", "b"][i % 2], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_the_whole_pipeline(spark, folder):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    clean = {*range(60), *range(500, 515)}
    assert got.keys() == clean


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_line_dedup_takes_effect(spark, folder):
    docs = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert docs.filter("text like '%rights reserved%'").count() == 0 and docs.count() == 85
    assert docs.filter("n_chars != length(text)").count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark, folder):
    w = prose(2, 90).split()
    near = [" ".join([*w[:i], f"x{i}", *w[i + 1 :]]) for i in (20, 30, 40)]
    rows = [(None, near[0]), (None, near[1]), (7, near[2]), (7, near[2]), (7, " ".join(w)), (8, prose(3, 50)), (9, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, folder).collect()
    assert len(got) == 4 and sum(r.text in (*near, " ".join(w)) for r in got) == 1


def lines_left(spark, folder, texts):
    rows = [(i, t, "en", "a", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, folder).collect()}


def test_line_dedup_takes_headers_and_footers_of_several_lines(spark, folder):
    body = {i: prose(3000 + i, 30) + "\n" + prose(4000 + i, 30) for i in range(36)}
    head, foot = "Welcome to our site\nNews from the whole region", "All rights reserved by us\nWritten by people like you\nSend us your own letters"
    texts = {i: f"{head}\n{b}" if i < 12 else f"{b}\n{foot}" if i < 24 else f"{head}\n{b}\n{foot}" for i, b in body.items()}
    assert lines_left(spark, folder, texts) == body


def test_line_dedup_counts_copies_once(spark, folder):
    body = {i: prose(3000 + i, 30) + "\nAll rights reserved by us\n" + prose(4000 + i, 30) for i in range(20)}
    body |= {100 + i: body[0] for i in range(10)}  # a third of the line's places
    want = {i: t.replace("All rights reserved by us\n", "") for i, t in body.items()}
    lines = [prose(6000 + j, 25) for j in range(12)]
    near = {200 + i: "\n".join([*lines[: i % 12], lines[i % 12] + f" edit{i}", *lines[i % 12 + 1 :]]) for i in range(30)}
    assert lines_left(spark, folder, body | near) == want | near


def test_line_dedup_takes_short_lines(spark, folder):
    body = {i: prose(3000 + i, 30) + "\n" + prose(4000 + i, 30) for i in range(15)}
    texts = {i: f"Advertisement\n{b}\n\tRead more\r\nPage {i}\n{i}.5" for i, b in body.items()}
    assert lines_left(spark, folder, texts) == {i: f"{b}\n{i}.5" for i, b in body.items()}
    few = {i: texts[i] for i in range(9)}
    assert lines_left(spark, folder, few) == few


def test_line_dedup_runs_no_python(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    monkeypatch.delattr(type(docs), "mapInArrow")
    assert corpus_pipeline.line_dedup(spark, docs, folder).count() == 85


@pytest.mark.parametrize("name", ["plain", "nasty"])
def test_groups_are_the_same_with_and_without_python(request, spark, name):
    docs = keyed(request.getfixturevalue(name))
    got, want = (sorted(map(str, grouped(docs, 5, 80, 5, 40, native=native).collect())) for native in (True, False))
    assert got == want


def test_groups_leave_no_tables_behind(spark, plain):
    at = shared_folder(spark).removeprefix("file:")
    before = {f for f in os.listdir(at) if f.startswith("table-")}
    assert grouped(keyed(plain), 5, 80, 5, 40).agg(F.max("component_id")).first()[0] > 0
    assert {f for f in os.listdir(at) if f.startswith("table-")} <= before
