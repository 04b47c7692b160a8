"""Content search: an inverted index as tables, BM25 ranking, and index statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions.text import let, tokens, varint_bytes

K1, B, TF_MAX = 1.2, 0.75, 255


def counted(words: Column) -> Column:
    """Distinct words with their counts, (term, tf), in order; tf is at most 255."""

    def runs(w: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.get(w, i - 1).eqNullSafe(F.get(w, i)))
        count = lambda e: lambda at, n: F.struct(F.get(w, at - 1).alias("term"), F.least(at - F.coalesce(F.get(e, n - 1), F.lit(0)), F.lit(TF_MAX)).alias("tf"))
        return let(last, lambda e: F.transform(e, count(e)))

    return F.when(F.size(words) > 0, let(F.array_sort(words), runs))


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, key, tf) of documents, a row for each key; tf is at most 255.

    Terms are counted inside the row, so nothing is shuffled.
    """
    return docs.select(key, F.explode(counted(tokens(F.col(text)))).alias("p")).select("p.term", key, "p.tf")


def lengths(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, doc_len) of the documents that have a token."""
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("doc_len")).filter("doc_len > 0")


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(posts: DataFrame, lens: DataFrame, query: list[str], key: str = "doc_id") -> DataFrame:
    """(key, score) of all documents with a query term, from stored postings and lengths; a term given twice counts twice.

    Postings are filtered before anything is joined; the corpus row has two numbers.
    """
    spark = posts.sparkSession
    terms: dict[str, int] = {}
    for t in query:
        terms[t] = terms.get(t, 0) + 1
    if not terms:
        return spark.createDataFrame([], f"{key} long, score double")
    q = spark.createDataFrame(list(terms.items()), "term string, times int")
    hit = posts.filter(F.col("term").isin(list(terms))).join(q, "term")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lens.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
    s = hit.join(df, "term").join(lens, key).crossJoin(F.broadcast(corpus))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl"))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / norm * F.col("times")
    return s.groupBy(key).agg(F.sum(part).alias("score"))


def matched(docs: DataFrame, query: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) like ``bm25`` straight from the documents, a row for each key.

    Two scans and no shuffle of texts or terms: the first counts, in a row for the whole
    corpus, documents, tokens and the documents with each term; the second scores the
    documents that hold a term as a substring.
    """
    terms: dict[str, int] = {}
    for t in query:
        terms[t] = terms.get(t, 0) + 1
    if not terms:
        return docs.sparkSession.createDataFrame([], f"{key} long, score double")
    words, n = tokens(F.col(text)), range(len(terms))
    size = F.when(F.size("w") > 0, F.size("w"))
    df = [F.count(F.when(F.array_contains("w", t), 1)).alias(f"df{i}") for i, t in enumerate(terms)]
    corpus = docs.select(words.alias("w")).agg(F.count(size).alias("n"), F.avg(size).alias("avgdl"), *df)

    def counts(w: Column) -> Column:
        times = [F.least(F.size(F.filter(w, lambda x: x == t)), F.lit(TF_MAX)).alias(f"tf{i}") for i, t in enumerate(terms)]  # noqa: B023
        return F.struct(F.size(w).alias("dl"), *times)

    any_of = lambda each: reduce(lambda a, b: a | b, each)
    # Inside one generator, so that no filter computes the tokens again.
    hit = F.explode(F.filter(F.transform(F.array(words), counts), lambda c: any_of([c[f"tf{i}"] > 0 for i in n])))
    some = docs.filter(any_of([F.lower(text).contains(t) for t in terms])).select(key, hit.alias("c")).select(key, "c.*").crossJoin(F.broadcast(corpus))  # one row
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = lambda i, n: F.when(F.col(f"tf{i}") > 0, idf(F.col("n"), F.col(f"df{i}")) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm) * n).otherwise(0.0)
    return some.select(key, reduce(lambda a, b: a + b, [part(i, n) for i, n in enumerate(terms.values())]).alias("score"))


def top(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best by score, ties by the given columns."""
    return scores.orderBy(F.desc("score"), *ties).limit(k)


def index_size(posts: DataFrame, key: str = "doc_id", part: int = 1 << 20) -> DataFrame:
    """One row: terms, postings, and bytes of the postings as varint gaps of sorted ids.

    A term's list is cut into ranges of ``part`` ids, each sorted on its own, so that a term
    of all documents is many tasks; only a range's first and last id meet their neighbours.
    """
    cut = posts.select("term", key, F.floor(F.col(key) / part).alias("r"))
    w = Window.partitionBy("term", "r").orderBy(key)
    inner = cut.select("term", "r", key, varint_bytes(F.col(key) - F.lag(key).over(w)).alias("b"), F.lag(key).over(w).isNull().alias("head"))
    ranges = inner.groupBy("term", "r").agg(F.count("*").alias("c"), F.sum(F.when(~F.col("head"), F.col("b")).otherwise(0)).alias("b"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    before = F.coalesce(F.lag("hi").over(Window.partitionBy("term").orderBy("r")), F.lit(0))
    by_term = ranges.select("term", "c", (F.col("b") + varint_bytes(F.col("lo") - before)).alias("b")).groupBy("term").agg(F.sum("c").alias("c"), F.sum("b").alias("b"))
    return by_term.agg(F.count("*").alias("terms"), F.sum("c").cast("long").alias("postings"), F.sum("b").cast("long").alias("gap_bytes"))


def top_term_cut(posts: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """(cut, removed, share): postings saved by leaving out the most frequent terms."""
    by_term = posts.groupBy("term").agg(F.count("*").alias("c"))
    best = by_term.orderBy(F.desc("c"), "term").limit(max(cuts))
    place = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("c"), "term")))  # at most max(cuts) rows
    total = by_term.agg(F.sum("c").alias("all"))
    spark = posts.sparkSession
    at = spark.createDataFrame([(c,) for c in cuts], "cut long")
    return at.join(place, F.col("rank") <= F.col("cut")).groupBy("cut").agg(F.sum("c").cast("long").alias("removed")).crossJoin(F.broadcast(total)).select("cut", "removed", F.round(F.col("removed") / F.col("all"), 6).alias("share"))
