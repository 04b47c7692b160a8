"""Mixing sources to target weights by hash-threshold histograms.

Every document has a uniform hash of its id.  A source whose target is r times its
size takes each of its documents floor(r) times, and once more those below a
threshold of the hash at which the sizes add up to what is still missing.  The
threshold is found without sorting: sizes are summed by source and the leading bits
of the hash; the bucket in which the budget runs out is split by the next bits, and
so on until that bucket holds one hash value.  Only rows of boundary buckets are
read again, and a mix with smaller targets is a subset of one with larger ones.

Null texts have size 0 and a null source is a source of its own, the last one.
Rows with one doc_id share a hash and are taken together.  Weights follow the
order of the source names by code point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.llm.base import settled

BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...], budget: float, most: float) -> dict[str | None, float]:
    """The target of each source: budget shared by weight, none above ``most`` times its size; the excess is reshared."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    open_, left = list(names), budget * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs``."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")
    rows = settled(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed.alias("h")))
    level = STEP

    def part(df: DataFrame, bits: int) -> DataFrame:
        return df.groupBy("source", F.shiftrightunsigned("h", BITS - bits).alias("p")).agg(F.sum("size").alias("size"), F.count_distinct("h").alias("n"))

    # One row for each source and bucket, at most 2**STEP for a source.
    first = settled(part(rows, level))
    sizes = {r[0]: r[1] for r in first.groupBy("source").agg(F.sum("size")).collect()}
    goal = targets(sizes, weights, budget, most)
    whole = {s: (int(goal[s] // n) if n else 0) for s, n in sizes.items()}
    need = {s: goal[s] - whole[s] * n for s, n in sizes.items()}
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, float(need[s])) for s in sizes], "named string, need double")

    def boundary(hist: DataFrame, plan: DataFrame) -> DataFrame:
        """For each source the bucket in which its need runs out: (source, p, before, inside, n, need)."""
        w = Window.partitionBy("source").orderBy("p")
        run = hist.join(plan, hist.source.eqNullSafe(plan.named)).select("source", "p", "size", "n", "need", F.sum("size").over(w).alias("upto"))
        cut = run.filter("upto > need and upto - size <= need")
        return cut.groupBy("source").agg(F.min(F.struct("p", (F.col("upto") - F.col("size")).alias("before"), F.col("size").alias("inside"), "n", "need")).alias("c")).select("source", "c.*")

    # A row for each source; sources are few by the contract of a mix.
    limit: dict[str | None, int] = {s: 2**BITS for s in sizes}
    hist, before = first, dict.fromkeys(sizes, 0.0)
    while True:
        cut = boundary(hist, plan).collect()
        go_on = []
        for r in cut:
            low = r.p << (BITS - level)
            if level >= BITS or r.n == 1:
                # One hash value: in if that comes nearer to the target.
                near = r.before + r.inside - r.need < r.need - r.before
                limit[r.source] = low + (1 << (BITS - level)) if near else low
            else:
                go_on.append((r.source, r.p, float(r.need - r.before)))
        if not go_on:
            break
        inside = spark.createDataFrame(go_on, "named string, q long, need double")
        plan = inside.select("named", "need")
        narrow = rows.join(inside, rows.source.eqNullSafe(inside.named) & (F.shiftrightunsigned("h", BITS - level) == F.col("q"))).select("source", "h", "size")
        level = min(BITS, level + STEP)
        hist = settled(part(narrow, level))
    known = spark.createDataFrame([(s, sizes[s], float(goal[s]), whole[s], limit[s] if need[s] > 0 else 0) for s in sizes], "named string, source_size long, target double, whole int, upto long")
    out = rows.join(known, rows.source.eqNullSafe(known.named))
    copies = F.col("whole") + F.when(F.col("h") < F.col("upto"), 1).otherwise(0)
    out = out.withColumn("copies", F.least(copies, F.lit(int(most))))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
