import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomgrid.llm import minhash, phrases, repeats, runs
from fathomgrid.llm import textkernel as tk
from fathomgrid.llm.base import keyed


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\né", max_size=30)), max_size=6))
def test_words_match_bytes_split(texts):
    w = tk.Words(pa.array(texts, pa.string()), lower=True)
    for i, t in enumerate(texts):
        assert [w.text(j) for j in range(w.first[i], w.first[i + 1])] == words(t, True)
    by_hash = {}
    for j in range(len(w.start)):
        assert by_hash.setdefault(int(w.hash[j]), w.text(j)) == w.text(j)


def test_sliding_min():
    x = np.random.Generator(np.random.PCG64(1)).integers(0, 50, 97).astype(np.uint64)
    for w in (1, 2, 7, 97):
        assert tk.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def shingles(t, k):
    w = words(t, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                comp[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize(("k", "percent", "bands"), [(3, 85, 28), (5, 80, 40)])
@pytest.mark.parametrize("table", ["plain", "nasty"])
def test_near_duplicates(request, table, k, percent, bands):
    df = request.getfixturevalue(table)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k, percent, bands=bands).collect())
    assert got == Counter(components(rows_of(df), k, percent))


def test_near_duplicates_of_a_family_of_edits(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 400)}"
        texts.append(" ".join(w))
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "again"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == Counter(components(rows_of(df), 3, 85))


def test_near_duplicates_of_a_family_of_cuts(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(70):
        cut, at = rng.randint(1, 45), rng.choice((0, 150, rng.randint(0, 150)))
        w = base[cut:] if at == 0 else base[: 150 - cut] if at == 150 else base[:at] + base[at + cut :]
        w += [f"more{rng.randint(0, 3)} {j}" for j in range(rng.choice((0, 0, 5, 12)))]
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, percent in ((3, 85), (1, 70)):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k, percent, bands=60).collect())
        assert got == Counter(components(rows_of(df), k, percent))


def test_a_family_of_ten_thousand_forms_no_pairs(spark):
    rng, texts = random.Random(13), []
    for i in range(10_000):  # none is similar enough to the first or to another, but all share most with it
        w = [f"w{j}" for j in range(100)]
        for e, at in enumerate(range(rng.randint(0, 19), 100, 20) if i else ()):
            w[at] = f"e{i}.{e}"
        texts.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert got.filter("kept").count() == 10_000


def test_members_that_share_a_few_edits_are_not_compared(spark, monkeypatch):
    rng, texts = random.Random(14), []
    for i in range(400):  # edits come from one list, so members share rare differences, and few are similar enough
        w = [f"w{j}" for j in range(100)]
        for at in rng.sample(range(100), 12 if i else 0):
            w[at] = f"e{at}"
        texts.append((i, " ".join(w)))
        if i % 50 == 1:
            texts.append((1000 + i, " ".join([*w, "more"])))
    compared, settled = [], minhash.settled
    monkeypatch.setattr(minhash, "settled", lambda df: (compared.append(df.count()) if df.columns == ["a", "b", "na", "nb"] else None, settled(df))[1])
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == Counter(components(rows_of(df), 3, 85))
    assert len(compared) == 2 and compared[1] < 400  # after the stars' own pairs


def test_parities_never_hide_a_link(spark):
    rng = random.Random(15)
    sets = [rng.sample(range(2000), rng.randint(0, 900)) for _ in range(30)]
    rows = [(w, [h * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for h in s], sorted(s)) for w in (1, 5, 16) for s in sets]
    df = spark.createDataFrame(rows, "w int, d array<long>, s array<long>").withColumn("bits", minhash.parities())
    both = df.alias("p").join(df.alias("q"), "w").select("p.s", F.col("q.s").alias("t"), minhash.unlike("p.bits", "q.bits").alias("u"))
    for r in both.collect():
        assert r.u <= len(set(r.s) ^ set(r.t)) and (r.s != r.t or r.u == 0)


def test_signatures_agree_as_often_as_the_sets():
    rng = np.random.Generator(np.random.PCG64(3))
    for size in (20, 60, 2000):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (size, size // 8, size // 8))
        x, y = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
        sig = minhash.signature([x, y], 2000)
        assert abs((sig[0] == sig[1]).mean() - size / (size + 2 * (size // 8))) < 0.12


def later_words(rows, window):
    seen, out, done = set(), [], {}
    for i, t in rows:
        key = (i, t)
        if key not in done:  # equal rows are one document
            w = words(t)
            gone = [0] * len(w)
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                if k in seen:
                    gone[j : j + window] = [1] * window
                seen.add(k)
            done[key] = (i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
        out.append(done[key])
    return out


@pytest.mark.parametrize(("limits", "window"), [({}, 20), ({"most": 2000}, 8), ({"wide": 1}, 20), ({"wide": 3000}, 8)])
def test_phrases(plain, limits, window):
    got = Counter(tuple(r) for r in phrases.without_repeats(plain, window=window, **limits).collect())
    assert got == Counter(later_words(rows_of(plain), window))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=8, max_size=30), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: tuple(x[0])))
def test_automaton_finds_every_occurrence(segments):
    window = 8
    rows = [{"s": i, "n": n, "k1": (i * 7) % 5, "k2": 0, "a": i, "len": len(t) - window + 1, "content": " ".join(t).encode()} for i, (t, n) in enumerate(segments)]
    got = {(s, copy): b for s, copy, b in phrases.automaton(window)(rows)}
    seen = Counter()
    for r in rows:
        for j in range(r["len"]):
            seen[tuple(segments[r["s"]][0][j : j + window])] += r["n"]
    met, want = set(), {}
    for r in sorted(rows, key=lambda r: (r["k1"], r["a"])):
        words_ = segments[r["s"]][0]
        found, later = [], []
        for j in range(r["len"]):
            p = tuple(words_[j : j + window])
            found.append(seen[p] > 1)
            later.append(p in met)
            met.add(p)
        for copy, flags in ((0, later), (1, found)):
            if any(flags) and (copy == 0 or r["n"] > 1):
                want[r["s"], copy] = repeats.bounds(np.array(flags))
    assert got == want


def test_phrases_in_odd_tables(nasty, empty):
    once = nasty.filter("doc_id is not null").filter("doc_id != 6")
    got = Counter(tuple(r) for r in phrases.without_repeats(once).collect())
    assert got == Counter(later_words(rows_of(once), 20))
    assert phrases.without_repeats(nasty).count() == nasty.count() and phrases.without_repeats(empty).count() == 0


def repeated_bytes(rows, window):
    count = Counter()
    for _, t in set(rows):
        b = (t or "").encode()
        count.update(b[j : j + window] for j in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if count[b[j : j + window]] > 1:
                gone[j : j + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("limits", "window"), [({}, 400), ({"most": 2000}, 90), ({"wide": 1}, 400), ({"wide": 3000}, 90)])
def test_run_index(plain, limits, window):
    got = Counter(tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in runs.without_repeats(plain, window=window, **limits).collect())
    assert got == Counter(repeated_bytes(rows_of(plain), window))


def test_nothing_recurs_but_by_the_index(plain):
    none = lambda rows: iter(())
    for limits in ({}, {"wide": 1}):
        assert repeats.repeated_windows(keyed(plain), repeats.Unit(False, 90, 64), none, **limits).count() == 0
        assert repeats.repeated_windows(keyed(plain), repeats.Unit(True, 8, 5), none, **limits).count() == 0


def test_periodic_texts(spark):
    texts = {0: "-" * 3000, 1: "-" * 1999, 2: "abcde" * 500, 3: "x" + "abcde" * 90, 4: ("y" * 170 + "z") * 9, 5: "-" * 450 + "ab", 6: "*" * 420}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for limits in ({}, {"wide": 1000}):
        got = Counter(tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in runs.without_repeats(df, **limits).collect())
        assert got == Counter(repeated_bytes(rows_of(df), 400))


def test_the_transform_can_be_undone():
    texts = [b"banana", b"bandana", b"", b"banana"]
    index = runs.RunIndex(texts)
    assert index.letters[index.letters >= 0].astype(np.uint8).tobytes().count(b"n") < sum(t.count(b"n") for t in texts)
    assert len(index.letters) == len(index.lengths) == len(index.head_samples) == len(index.tail_samples)
    column = np.repeat(index.letters, index.lengths)
    rows = np.flatnonzero(column >= 0)
    up = np.zeros(len(column), np.int64)  # suffixes of one letter stand in the order of the rows that carry it; the ends are last
    up[rows[np.argsort(column[rows], kind="stable")]] = np.arange(len(rows))
    for row, text in enumerate(texts, len(rows)):
        back = []
        while column[row] >= 0:
            back.append(int(column[row]))
            row = up[row]
        assert bytes(reversed(back)) == text


def test_run_index_in_odd_tables(nasty, empty):
    got = Counter(r.kept_sha256 for r in runs.without_repeats(nasty).collect())
    assert got == Counter(r[4] for r in repeated_bytes(rows_of(nasty), 400))
    assert runs.without_repeats(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=25), min_size=1, max_size=5), st.integers(0, 31))
def test_matching_statistics(texts, twice):
    times = [1 + (twice >> i & 1) for i in range(len(texts))]
    index = runs.RunIndex([t.encode() for t in texts], times)
    got = index.matching_statistics().tolist()
    for least in (1, 3, 8):
        assert ((index.matching_statistics(least) >= least) == (np.array(got) >= least)).all()
    assert int(index.lengths.sum()) == sum((len(t) + 1) * n for t, n in zip(texts, times, strict=True))
    own = len(got)
    texts = texts + [t for t, n in zip(texts, times, strict=True) if n > 1]
    places = [(i, j) for i, t in enumerate(texts) for j in range(len(t) + 1)]
    for n, (i, j) in enumerate(places[:own]):
        best = 0
        for p, q in places:
            if (p, q) != (i, j):
                m = 0
                while j + m < len(texts[i]) and q + m < len(texts[p]) and texts[i][j + m] == texts[p][q + m]:
                    m += 1
                best = max(best, m)
        assert got[n] == best
