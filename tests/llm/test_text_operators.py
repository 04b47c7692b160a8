import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import decontam, langid, linetree, loglinear, mixing, quality, styletree
from tests.llm.conftest import prose


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="page has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp;  more</h1><p>First <b>bold
text.<p>Second &eacute;&#233;&lt; one.<br>Same block.</p><div class="share">Share me</div><section class="comments"><p>Nice post</p></section></article>
<aside><p>Related</p></aside><div id="sidebar">Side</div><form><label>Name</label></form><footer>&copy; x</footer></body></html>"""


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text_by_priors(spark):
    got = styletree.main_text(pages_of(spark, [(1, "http://h/a", PAGE), (2, None, None), (3, "http://h/b", ""), (1, "http://h/a", PAGE), (4, "x", "<p>cut off & open <b>text<a hre")])).collect()
    texts = sorted((r.page_id, r.text) for r in got)
    want = "Title & more\n\nFirst bold text.\n\nSecond éé< one. Same block."
    assert texts == [(1, want), (1, want), (2, ""), (3, ""), (4, "cut off & open text")]
    assert styletree.main_text(pages_of(spark, []).limit(0)).count() == 0


def test_site_style_tree_removes_what_a_host_repeats(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"https://host.example/{i}", f'<body><div class="top"><p>Welcome to the site of everything</p></div><div class="body"><p>{prose(i, 40)}</p><p>{prose(i + 100, 30)}</p></div><div class="end"><p>All of this belongs to us</p></div></body>'))
    rows.append((99, "https://other.example/1", "<body><div class='top'><p>Welcome to the site of everything</p></div></body>"))
    got = {r.page_id: r.text for r in styletree.main_text(pages_of(spark, rows)).collect()}
    assert {r.page_id: r.text for r in styletree.main_text(pages_of(spark, rows), most=0).collect()} == got
    assert all(got[i] == f"{prose(i, 40)}\n\n{prose(i + 100, 30)}" for i in range(30))
    assert got[99] == "Welcome to the site of everything"


def test_the_tree_alone_removes_boilerplate(spark):
    page = "<header><p>Some site</p></header><div class='x1'><p>{0}</p><p>{1}</p></div><div class='x2'>{2}</div><footer>All of it is ours</footer>"
    rows = [(i, f"https://h/{i}", page.format(prose(i, 40), prose(i + 100, 30), "Buy this" if i % 2 else "Buy that")) for i in range(30)]
    for most in (200_000, 0):
        got = styletree.main_text(pages_of(spark, rows), priors=False, most=most).collect()
        assert {r.page_id: r.text for r in got} == {i: f"{prose(i, 40)}\n\n{prose(i + 100, 30)}" for i in range(30)}
        assert all((r.n_tree, r.n_priors) == (3, 0) for r in got)
    assert all((r.n_tree, r.n_priors) == (3, 0) for r in styletree.main_text(pages_of(spark, rows)).collect())


def test_importance_is_the_entropy(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), rng.randint(1, 9), rng.randint(1, 4), rng.randint(1, 6), rng.randint(1, 3)) for _ in range(300)]
    rows = list({r[:4]: r for r in rows}.values())
    texts, nodes = styletree.importance(spark.createDataFrame(rows, "host long, print long, style long, h long, n long"))
    want_texts, want_nodes = {}, {}
    for host, style in {(r[0], r[2]) for r in rows}:
        own = [r for r in rows if (r[0], r[2]) == (host, style)]
        prints = {r[1] for r in own}
        m = len(prints)
        entropy = lambda p: -sum(x * math.log(x, m) for x in p if x) if m > 1 else 1.0
        pages = {h: {r[1] for r in own if r[3] == h} for h in {r[3] for r in own}}
        # The entropy, to base m, of one page drawn from all m, less what is left when those with the text are known.
        content = {h: entropy([1 / m] * m) - math.log(len(p), m) if m > 1 else 1.0 for h, p in pages.items()}
        times = Counter(sum(r[4] for r in own if r[1] == p) for p in prints)
        presentation = entropy([c / m for c in times.values()])
        mean = sum(content[h] * len(p) for h, p in pages.items()) / sum(map(len, pages.values()))
        want_texts |= {(host, style, h): round(c, 9) for h, c in content.items()}
        want_nodes[host, style] = (m, round(0.9 * mean + 0.1 * presentation, 9))
    assert {(r.host, r.style, r.h): round(r.content, 9) for r in texts.collect()} == want_texts
    assert {(r.host, r.style): (r.m, round(r.importance, 9)) for r in nodes.collect()} == want_nodes


@pytest.mark.parametrize("bit", ["<a href=\"x>", "<a b='", "<p>", "<a ", "<!x ", "<a \">\" ", "<div class=x><td>", "<a>x<hr>", "</", "<a<", "<!-- ", "<b title='>'\"", "<li><span id=q>", "&lt;<i"])
def test_parsing_takes_linear_time(bit):
    began = time.process_time()
    styletree.blocks(bit * 20_000, {})
    short = time.process_time() - began
    styletree.blocks(bit * 100_000 + "<p>text", {})
    assert time.process_time() - began < 12 * short + 2


def test_tags_with_brackets_in_their_values():
    page = '<div title="a > b" class=\'x\'>one</div><p data-x="<b>">two</p><a href="x>three</a> four < five'
    assert [b[1] for b in styletree.blocks(page, {})] == ["one", "two", "three four < five"]


def test_copies_of_an_article_are_not_boilerplate(spark):
    rows = [(i, f"https://h/{i}", f"<article><p>{prose(1, 50)}</p></article>") for i in range(40)]
    assert {r.text for r in styletree.main_text(pages_of(spark, rows)).collect()} == {prose(1, 50)}


def test_site_style_tree_removes_paragraphs_longer_than_the_text(spark):
    legal = prose(900, 120)
    rows = [(i, f"https://h/{i}", f"<body><div class='body'><p>{prose(i, 30)}</p></div><div class='end'><p>{legal}</p></div></body>") for i in range(30)]
    got = {r.page_id: r.text for r in styletree.main_text(pages_of(spark, rows)).collect()}
    assert got == {i: prose(i, 30) for i in range(30)}


def test_copies_of_an_article_with_other_dates_are_not_boilerplate(spark):
    rows = [(i, f"https://h/{i}", f"<article><p>{prose(1, 50)}</p><p>Read {i} times</p></article>") for i in range(40)]
    assert all(r.text.startswith(prose(1, 50)) for r in styletree.main_text(pages_of(spark, rows)).collect())


def test_base_score_and_gain(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    follow = {w: rng.choice(list("abcdefghij"), 2) for w in "abcdefghij"}

    def text():
        w = ["a"]
        for _ in range(rng.integers(5, 80)):
            w.append(str(follow[w[-1]][rng.integers(0, 2)]))
        return " ".join(w)

    docs = spark.createDataFrame([(i, text()) for i in range(200)] + [(900, None), (901, ""), (None, "a Zeta"), (900, None)], "doc_id long, text string")
    held = langid.fold(F.col("doc_id")) % 5 == 1
    got = loglinear.scored(docs, docs.filter(~held)).collect()
    train, rows = Counter(), rows_of(docs)
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            train.update((t or "").lower().split())
            train["</s>"] += 1
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        w = [*(t or "").lower().split(), "</s>"]
        want[i, len(w), sum(train[x] > 0 for x in w), round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_probabilities_add_up(spark):
    near, far = np.random.Generator(np.random.PCG64(2)).integers(0, 9, (2, 30, 30))
    a, c = loglinear.trained(near, far, width=6, rounds=30)
    model = loglinear.Model.of(a, c[:-1], c[-1], 0.7, 0.5)
    w = np.arange(30)
    for u, v in ((0, 0), (3, 17), (29, 4)):
        assert abs(np.exp(model.log_probability(np.full(30, u), np.full(30, v), w)).sum() - 1) < 1e-4


def test_weights_have_the_best_likelihood_over_all_tokens():
    rng = np.random.Generator(np.random.PCG64(3))
    size, chosen = 12, set()
    pairs = ((1.0, 0.0), (0.9, 0.2), (0.8, 0.4), (0.7, 0.5), (0.6, 0.6), (0.5, 0.7), (0.9, 0.4), (0.8, 0.6))
    for x1, x2 in pairs:
        near, far = rng.normal(0, 1.5, (size, size)), rng.normal(0, 1.5, (size + 1, size))
        after, second, tokens = np.zeros((size, size)), np.zeros((size, size)), []
        for n in range(60):
            u = v = 0
            for left in range(n % 9, -1, -1):
                score = np.exp(x1 * near[v] + x2 * far[u] + far[-1])[1:]
                w = int(rng.choice(size - 1, p=score / score.sum())) + 1 if left else 0
                tokens.append((u, v, w))
                after[v, w] += 1
                second[u, w] += 1
                u, v = v, w
        got = loglinear.tuned(near, far, after, second)
        models = [loglinear.Model.of(near, far[:-1], far[-1], *x) for x in pairs]
        best = max(range(len(pairs)), key=lambda i: models[i].log_probability(*np.array(tokens).T).sum())
        chosen.add(best)
        assert (got.a == models[best].a).all() and (got.c == models[best].c).all()
    assert len(chosen) > 1


def test_long_training_documents_choose_the_weights_too(spark):
    rng = np.random.Generator(np.random.PCG64(9))

    def text(n):  # a word follows from the one before the last, if at all
        w = [f"a{i // 2 % 7}" if i % 2 == 0 else f"b{rng.integers(0, 20)}" for i in range(n)]
        return " ".join(w)

    ids = [r.id for r in spark.range(100).filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) > 600_000).limit(2).collect()]
    docs = spark.createDataFrame([(i, text(210_000)) for i in ids], "doc_id long, text string")
    for r in loglinear.scored(docs, docs).collect():
        assert r.score / r.n_tokens > (math.log10(1 / 20) + math.log10(1 / 2)) / 2


def test_scoring_odd_tables(nasty, empty):
    got = loglinear.scored(nasty, nasty).collect()
    assert len(got) == nasty.count() and all(r.score <= 0 and r.n_known == r.n_tokens for r in got)
    assert loglinear.scored(empty, empty).count() == 0
    assert all(r.n_known == 0 for r in loglinear.scored(nasty, empty).collect())


def oracle(df, sql):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con.execute(sql).fetchall()


def lines_result(df):
    out = linetree.without_recurring_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256))
    return Counter(tuple(r) for r in out.collect())


def test_recurring_lines(spark):
    rows = []
    for i in range(30):
        body = [prose(i * 3 + j, 12) for j in range(3)]
        body.insert(i % 3, f"Posted by user{i} on {i} May at home")
        body.append("All rights reserved by us")
        rows.append((i, "\n".join(body)))
    rows += [(i, "\n".join(prose(77 + j, 15) for j in range(5))) for i in range(40, 60)]  # copies keep their lines
    rows += [(90, None), (91, ""), (92, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in linetree.without_recurring_lines(df).collect()}
    assert all(got[i][0] == 2 and "Posted" not in got[i][1] and "rights" not in got[i][1] for i in range(30))
    assert all(got[i][0] == 0 for i in range(40, 60)) and got[90] == (0, None)
    assert lines_result(df.union(df)) == Counter(tuple(r) for r in oracle(df.union(df), linetree.SQL))
    assert lines_result(df) == Counter(tuple(r) for r in oracle(df, linetree.SQL))


def test_all_lines_of_headers_and_footers_recur(spark):
    head, foot = "Welcome to our site\nNews from the whole region\nMenu", "All rights reserved by us\nWritten by people like you\nSend us your own letters"
    body = {i: prose(3000 + i, 20) + "\n\n" + prose(4000 + i, 20) for i in range(40)}
    family = [prose(6000 + j, 12) for j in range(10)]
    near = {200 + i: "\n".join([*family[: i % 10], family[i % 10] + f" edit{i}", *family[i % 10 + 1 :]]) for i in range(60)}  # near copies keep theirs
    few = {300 + i: f"{prose(7000 + i, 25)}\nIn nine documents only" for i in range(9)}
    texts = {i: f"{head}\n{b}\nPage {i}\n{foot}" for i, b in body.items()} | {100 + i: f"{head}\n{body[0]}\nPage 0\n{foot}" for i in range(30)} | near | few
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in linetree.without_recurring_lines(df).collect()}
    assert got == body | dict.fromkeys(range(100, 130), body[0]) | near | few
    assert lines_result(df) == Counter(tuple(r) for r in oracle(df, linetree.SQL))


def test_lines_of_odd_tables(nasty, empty):
    twenty = nasty.select("doc_id", "text")
    for i in range(19):  # every line recurs in texts that differ
        twenty = twenty.union(nasty.select("doc_id", F.concat("text", F.lit(f"\n{prose(i, 5)}"))))
    for df in (nasty.select("doc_id", "text"), twenty):
        assert lines_result(df) == Counter(tuple(r) for r in oracle(df, linetree.SQL))
    assert linetree.without_recurring_lines(empty).count() == 0


def test_language(spark):
    words = {"en": "the of and house river light morning".split(), "de": "der und das haus fluss licht morgen".split(), "fr": "le et la maison fleuve lumière matin".split()}
    rng = np.random.Generator(np.random.PCG64(4))
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)] + [(500, "12 34 — €", "en"), (501, None, "en"), (502, "", None), (None, "the house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.fold(F.col("doc_id")) % 5 == 0
    got = langid.identified(docs, langid.fit(docs.filter(~held))).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang and 0 <= by[i].score <= 1 for i, _, lang in rows[:120])
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[None].lang_pred == "en" and by[501].score == 0
    unseen = spark.createDataFrame([(1, "Flusslicht Morgenhaus"), (2, "lumièrematin maisonfleuve")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identified(unseen, langid.fit(docs)).orderBy("doc_id").collect()] == ["de", "fr"]


def test_words_are_runs_of_letters():
    texts = ["“Quick”, fox—jumped… «BONJOUR» l’Été", "ПРИВЕТ, мир! ΣΟΦΊΑ", "今日は tea", "नमस्ते 12 a1b", None, "12 — €", "́"]
    v = langid.Vocabulary(pa.array(texts, pa.string()))
    words = ["".join(map(chr, v.chars[s : s + n].tolist())) for s, n in zip(v.start, v.size, strict=True)]
    got = [[words[k] for k in v.back[v.doc == i]] for i in range(len(texts))]
    assert got[:4] == [["quick", "fox", "jumped", "bonjour", "l", "été"], ["привет", "мир", "σοφία"], ["今", "日", "は", "tea"], ["नमस्ते", "a", "b"]]
    assert v.lettered.tolist() == [True] * 4 + [False] * 3 and v.count.tolist()[:6] == [6, 3, 4, 3, 0, 0]
    one = lambda w, n: ["".join(map(chr, x)) for x in zip(*((2, *map(ord, w), 3)[j:] for j in range(n)), strict=False)]
    for order in (1, 2, 4):
        key, of = v.grams(np.arange(len(words)), order)
        assert Counter(of.tolist()) == Counter({i: len(one(w, order)) for i, w in enumerate(words) if one(w, order)})
        assert len(set(key.tolist())) == len({g for w in words for g in one(w, order)})


def test_language_of_odd_tables(nasty, empty):
    assert langid.identified(nasty, langid.fit(nasty)).count() == nasty.count()
    assert {r.lang_pred for r in langid.identified(nasty, langid.fit(empty)).collect()} == {"und"}


def grams(t, k=5):
    w = (t or "").encode().lower().split()
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def best_windows(docs, items, similarity=0.8):
    out = {}
    for n, (d, t) in enumerate(docs):
        w = (t or "").encode().lower().split()
        for i, x in items:
            a = Counter(grams(x))
            size = min(len((x or "").split()), len(w))
            for s in range(len(w) - size + 1) if a and w else ():
                b = Counter(grams(b" ".join(w[s : s + size]).decode()))
                both = sum((a & b).values())
                score = both / (sum(a.values()) + sum(b.values()) - both)
                if score >= similarity and score > out.get((n, d, i), (0, 0))[0]:
                    out[n, d, i] = (score, s)
    return Counter((d, i, s, round(v, 9)) for (_, d, i), (v, s) in out.items())


def test_decontamination(spark, nasty):
    items = [(i, prose(1000 + i, n)) for i, n in enumerate((45, 30, 12, 60, 3, 1))] + [(6, None), (7, ""), (8, items_copy := prose(1000, 45)), (None, prose(1001, 30))]
    rows = [(0, prose(1, 30) + " " + items[0][1].upper() + " " + prose(2, 30)), (1, items[1][1]), (2, None), (3, ""), (4, prose(3, 200))]
    cut = items[3][1].split()
    cut[20] = "other"
    rows += [(5, prose(4, 10) + " " + " ".join(cut)), (6, "x " + items[4][1] + " y"), (7, items[5][1]), (8, " ".join(items[0][1].split()[:40])), (None, items_copy)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, item_id long, similarity string")
    bench = spark.createDataFrame([(*r, 0.5) for r in items], "item_id long, text string, start double")
    for block in (5000, 2):
        got = Counter((r.doc_id, r.item_id, r.start, round(r.similarity, 9)) for r in decontam.contaminated(docs, bench, block=block).collect())
        assert got == best_windows(rows, items)
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0
    got = Counter((r.doc_id, r.item_id, r.start, round(r.similarity, 9)) for r in decontam.contaminated(nasty, bench).collect())
    assert got == best_windows(rows_of(nasty), items)


def test_index_finds_all_within_the_radius():
    items = decontam.Items(list(range(40)), [prose(i, 20) for i in range(40)], 5, 0.8)
    rng = np.random.Generator(np.random.PCG64(6))
    prints, wanted = [], []
    for i, f in enumerate(items.print):
        for distance in (0, 1, 8, 40, decontam.RADIUS):
            for _ in range(20):
                bits = np.unpackbits(f.view(np.uint8))
                bits[rng.choice(decontam.BITS, distance, replace=False)] ^= 1
                prints.append(np.packbits(bits).view("<u2"))
                wanted.append((len(prints) - 1, i))
    found = set(zip(*(x.tolist() for x in items.candidates(np.array(prints))), strict=True))
    assert found >= set(wanted) and len(found) < 2 * len(wanted)


def test_fingerprints_of_similar_windows_are_near():
    rng, far, total = random.Random(4), 0, 0
    for n in range(300):
        words = prose(n, 44).split()
        other = list(words)
        for at in rng.sample(range(44), 1):
            other[at] = "changed"
        items = decontam.Items([0, 1], [" ".join(words), " ".join(other)], 5, 0.8)
        if items.alike(0, items.shingles[1]) >= 0.75:
            total += 1
            far += 1 not in items.candidates(items.print[:1])[1]
    assert total > 200 and far <= 1


def test_targets():
    sizes = {"b": 100, "a": 100, None: 100, "c": 1000}
    t = mixing.targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert t["a"] == 200 and t["b"] == 200 and t[None] == 200 and abs(t["c"] - (1950 - 600)) < 1e-9
    assert mixing.targets({}, (5, 2, 1), 1.5, 2.0) == {}
    assert mixing.targets({"a": 0}, (5,), 1.5, 2.0) == {"a": 0.0}


def test_mixture(spark):
    rows = [(i, prose(i, 5 + i % 50), ["web", "book", "law", None][i % 4 if i % 7 else 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert len(got) == 400 and all(r.size == len(dict((a, b) for a, b, _ in rows)[r.doc_id].split()) and r.taken in (0, r.size, 2 * r.size) for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 55 / 2 + 1e-9 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))


def test_mixing_odd_tables(nasty, empty):
    got = mixing.mixed(nasty).collect()
    assert len(got) == nasty.count() and all(r.taken <= 2 * r.size for r in got) and mixing.mixed(empty).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


@pytest.mark.parametrize("table", ["plain", "nasty", "empty"])
def test_quality_measures(request, table):
    df = request.getfixturevalue(table)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judged(df).collect())
    assert got == Counter((i, *base(t)) for i, t in rows_of(df))


def test_rules_disagree_and_the_posterior_decides():
    rng = np.random.Generator(np.random.PCG64(8))
    good = rng.random(4000) < 0.8
    votes = np.where(good[:, None], rng.random((4000, 6)) < 0.97, rng.random((4000, 6)) < 0.55).astype(int)
    votes[rng.random(votes.shape) < 0.1] = -1
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    prior, right = quality.fit(pattern, counts.astype(float))
    p = quality.posterior(votes, prior, right) >= 0.5
    assert (p == good).mean() > 0.93 and abs(prior - good.mean()) < 0.06
    assert (votes[p] == 0).any(axis=1).sum() > 0


def test_bad_documents_are_rejected(spark):
    rows = [(i, prose(i, 120)) for i in range(150)] + [(1000 + i, " ".join(w + "###" for w in prose(i, 120).split())) for i in range(20)] + [(2000 + i, "buy now cheap here today " * 40) for i in range(10)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(150)) >= 148 and not any(v for k, v in got.items() if k >= 1000)
