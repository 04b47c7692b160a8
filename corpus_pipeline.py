"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents.  Rows are told apart by doc_id and
text together, so rows that share an id are judged each on its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm import decontam, linetree, minhash, mixing, quality
from fathomgrid.llm.base import deleted, keyed, shared_folder, stored, table


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _groups(rows: DataFrame) -> DataFrame:
    """(k1, k2, group) of keyed documents: near-duplicates, by five-word shingles at similarity 0.8 or more, share a group."""
    own = rows.select("k1", "k2", F.xxhash64("k1", "k2").alias("doc_id"), "text")  # doc_ids may be null or clash
    return minhash.grouped(own, k=5, percent=80, rows=5, bands=40, native=True).select("k1", "k2", F.col("component_id").alias("group"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    verdict = quality.judged(docs.select(_row().alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("row")).distinct()
    return docs.withColumn("row", _row()).join(verdict, "row", "left_semi").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents other than near copies."""
    rows = keyed(docs, *(c for c in docs.columns if c not in ("doc_id", "text")))
    x = F.xxhash64("k1", "k2").alias("x")
    copies = stored(_groups(rows).filter(F.col("group") != x).select(x, "group"))
    drop = linetree.boilerplate(rows.filter("text is not null").select(x, linetree.salt("doc_id"), "text"), copies)
    out = rows.withColumn("x", x).join(drop.hint("merge"), "x", "left").withColumn("text", linetree.left(F.col("text"), F.col("drop")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    rows = keyed(docs, *(c for c in docs.columns if c not in ("doc_id", "text")))
    groups = minhash.grouped(rows.select("k1", "k2", "doc_id", "text"), k=5, percent=80, rows=5, bands=40)
    kept = groups.filter(F.col("head").isNull() | (F.struct("k1", "k2") == F.col("head"))).select("k1", "k2")  # ids may be null or clash
    return rows.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item."""
    found = decontam.contaminated(docs.select(_row().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.withColumn("row", _row()).join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document that is left."""
    return mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: Fitted accuracies, buckets and fingerprints can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            deleted(spark, f"{folder}/{i - 1}")
    return docs
