"""What the operators share: reading tables, cutting lineage, keys of documents."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a doc_id that is null; it sorts before every other.
NO_ID = -(2**63)


#: Rows that go to a Python worker at once: texts are long, and a worker holds a few copies of them.
BATCH = "500"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's Arrow batches become small from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set a temporary one is made on one machine, and a cluster is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that lost executors don't matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that are no longer referred to.

    Twice, with a pause: the end of a query still refers to it for a moment, and what
    Python lets go of reaches the JVM's collector only after that.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``shared_folder`` holds."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and columns compress."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    freed(spark)
    return spark.read.schema(df.schema).parquet(path)


def unstored(table: DataFrame) -> None:
    """Removes a table that ``stored`` wrote; nothing that is still to be computed may read it."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        deleted(table.sparkSession, path)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(k1, k2, doc_id, text, more) of documents: k1 is doc_id or NO_ID, and k2 tells rows of one doc_id apart.

    Equal rows share a key and so their results.  k2 is 0 unless a doc_id recurs.
    """
    docs = docs.select("doc_id", "text", *more)
    k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.select(k1, F.lit(0).alias("k2"), "doc_id", "text", *more)
    texts = docs.select(k1, F.xxhash64("text").alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("k1").orderBy("h")) - 1
    ranks = texts.select("k1", "h", rank.alias("k2"))
    out = docs.select(k1, F.xxhash64("text").alias("h"), "doc_id", "text", *more).join(ranks, ["k1", "h"])
    return settled(out.select("k1", "k2", "doc_id", "text", *more))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of all ends of ``edges`` (a, b): comp is the least id of the component.

    Least labels go over the edges and then along the labels themselves, which
    halves the remaining distance in every round; nothing is collected.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        step = settled(step)
        up = step.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = settled(step.join(up, "comp").select("id", F.least("comp", "far").alias("comp"), "old"))
        if new.filter("comp != old").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", "comp")
        del near, step, up, new
        freed(edges.sparkSession)  # a round's shuffle files, and the labels before
