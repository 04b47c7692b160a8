"""Registered queries of the operators of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm import decontam, langid, linetree, loglinear, minhash, mixing, phrases, quality, runs, styletree
from fathomgrid.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_styletree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = styletree.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_tree", "n_priors")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.without_repeats(table(spark, sf_dir, "documents"), window=400).drop("kept")


def op4_loglinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id")) % 5 == 1
    out = loglinear.scored(docs, docs.filter(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.without_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_linetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linetree.without_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id")) % 5 == 0
    out = langid.identified(docs, langid.fit(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_styletree, op2_minhash, op3_run_index, op4_loglinear, op5_phrases, op6_linetree, op7_langid, op8_decontam, op9_mixing, op10_quality)}

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {"op6_linetree": linetree.SQL}
