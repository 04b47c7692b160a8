import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, k2 string, node long, row long, h long, drop string, comp long"
WORDS = "the of and river stone house light morning people water garden letter window village market".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) * (rng.random() < 0.5) for _ in range(n))


def document_rows():
    base = prose(1, 400)
    words = base.split()
    rows = [
        (1, base), (2, None), (3, ""), (4, " \t\n \x0b"), (5, base), (5, base), (6, prose(2, 300)), (6, prose(3, 120)), (None, base), (None, prose(4, 90)), (None, None),
        (7, " ".join(words[:150] + ["changed"] + words[151:])), (8, "one"), (9, "One"), (10, "one two"), (11, "no"), (12, "loop back " * 400), (13, "\n".join(["same line again"] * 30)),
        (14, "x" * 3000), (15, prose(5, 60) + "\n" + " ".join(words[100:180]) + "\n" + prose(6, 60)), (16, "\U0001f600 émile   naïve #tag 123"), (17, prose(7, 3000)),
        (18, "Copyright 2021 Example\n" + prose(8, 50)), (2**62, "# * $ % & | < >" * 20),
    ]
    return [(i, t, ["en", "de", None][n % 3], ["s1", "s2", None][n % 3], len(t or ""), n, "x", 0, 0, 0, "d", 0) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def nasty(spark):
    """Null, empty, repeated and clashing everything."""
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def plain(spark):
    """Documents with ids of their own: copies, near copies, shared passages."""
    rng = random.Random(5)
    texts = []
    for i in range(60):
        kind = i % 6
        if kind == 0 or i < 6:
            texts.append(prose(100 + i, rng.randint(30, 300)))
        elif kind == 1:
            texts.append(texts[rng.randrange(len(texts))])
        elif kind in (2, 3):
            w = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randint(1, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
            texts.append(" ".join(w))
        else:
            w = texts[rng.randrange(len(texts))].split()
            at = rng.randrange(max(1, len(w) - 80))
            texts.append(prose(200 + i, 20) + " " + " ".join(w[at : at + 80]) + " " + prose(300 + i, 20))
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()


@pytest.fixture(scope="session")
def empty(plain):
    return plain.limit(0)
