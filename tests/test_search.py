import math
import random
from collections import Counter

from pyspark.sql import functions as F

from fathomgrid.functions.text import tokens
from fathomgrid.operators import fuzzy, search


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_more_mentions_rank_higher(spark):
    d = docs_of(spark, ["def parse_router(): pass", "router " * 5, "nothing here"])
    hits = search.top(search.bm25(search.postings(d), search.lengths(d), ["router"]), 10, "doc_id").collect()
    assert [h.doc_id for h in hits] == [1, 0]


def naive(texts, query):
    toks = [t.lower().replace("_", " ").split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = {}
    for i, t in enumerate(toks):
        c = Counter(t)
        s = 0.0
        for q in query:
            df = sum(q in x for x in toks)
            tf = min(c[q], 255)
            if tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if s:
            out[i] = s
    return out


def test_equals_a_naive_ranking(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    d, query = docs_of(spark, texts), ["aa", "ff", "aa", "zz"]
    got = {r.doc_id: r.score for r in search.bm25(search.postings(d), search.lengths(d), query).collect()}
    want = naive(texts, query)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_straight_from_the_documents(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.randint(1, 300))) for _ in range(20)] + ["Aa-AA aab", "", None]
    d, query = docs_of(spark, texts), ["aa", "ff", "aa", "zz"]
    want = {r.doc_id: r.score for r in search.bm25(search.postings(d), search.lengths(d), query).collect()}
    got = {r.doc_id: r.score for r in search.matched(d, query).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert search.matched(d, []).count() == 0 and search.matched(d.limit(0), ["aa"]).count() == 0


def test_index_size_does_not_depend_on_the_ranges(spark):
    rng = random.Random(5)
    ids = sorted(rng.sample(range(1, 40_000), 60))
    d = spark.createDataFrame([(i, "every " + rng.choice("aa bb cc".split()) + (" rare" if n == 30 else "")) for n, i in enumerate(ids)], "doc_id long, text string")
    posts = search.postings(d)
    rows = [tuple(search.index_size(posts, part=part).first()) for part in (1, 7, 500, 1 << 20)]
    last, total = {}, 0
    for r in sorted(posts.collect(), key=lambda r: r.doc_id):
        gap = r.doc_id - last.get(r.term, 0)
        total += 1 if gap < 128 else 2 if gap < 1 << 14 else 3
        last[r.term] = r.doc_id
    assert rows == [(len(last), 60 * 2 + 1, total)] * 4


def test_empty_query_and_table(spark):
    d = docs_of(spark, ["a"])
    assert search.bm25(search.postings(d), search.lengths(d), []).count() == 0
    empty = d.limit(0)
    assert search.bm25(search.postings(empty), search.lengths(empty), ["a"]).count() == 0


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_file_name_beats_scattered_letters(spark):
    p = paths(spark, ["rust/tests/ui/lint/outer-forbid.rs", "router.js", "unrelated.txt"])
    assert fuzzy.ranked(p, "router", 5).first().path == "router.js"


def test_scope_follows_the_slash(spark):
    p = paths(spark, ["router/unrelated.txt", "other.txt"])
    assert fuzzy.ranked(p, "router", 5).count() == 0
    assert fuzzy.ranked(p, "router/u", 5).count() == 1
    assert fuzzy.ranked(p, "", 5).count() == 0


def test_filter_and_score_agree(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abAB/_-.") for _ in range(12)) for _ in range(200)]
    for q in ("ab", "aab", "b_a", "a.b"):
        kept = {r.path for r in paths(spark, names).filter(fuzzy.has_subsequence(F.substring_index("path", "/", -1), q)).collect()}
        assert kept == {n for n in names if fuzzy.score(n, q, False) is not None}


def test_bonuses():
    assert fuzzy.score("a_b.py", "b", False) > fuzzy.score("aab.py", "b", False)
    assert fuzzy.score("fooBar", "b", False) > fuzzy.score("foobar", "b", False)
    assert fuzzy.score("xabx", "ab", False) > fuzzy.score("xaxb", "ab", False)
    assert fuzzy.score("abc", "abd", False) is None


def test_tokens_column(spark):
    assert spark.range(1).select(tokens(F.lit("A b"))).first()[0] == ["a", "b"]
