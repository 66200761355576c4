"""What the corpus operators share: table reading and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_TAG, _ID = "_tidelog_tag", "_tidelog_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only in local mode, where that is unset."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and no executor's loss costs it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished jobs, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def tidy(run):
    """A mapInArrow function that, once its task is over, gives memory back that the allocators would keep: a Python worker lives
    on through the stages that follow, and an executor has several."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_rows(docs: DataFrame, verdicts: DataFrame, tag: Column, one: bool, doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose verdict in the table verdicts (doc_id, tag, kept) is no; one: of rows alike, one stays.

    tag is a hash of what the verdict came from, so rows that share a doc_id (or have none) are judged on their own.
    """
    keys = verdicts.select(F.col("doc_id").alias(_ID), F.col("tag").alias(_TAG), "kept")

    def match(rows: DataFrame, by: DataFrame, how: str) -> DataFrame:
        by = by.select(F.col(_ID).alias("id"), F.col(_TAG).alias("tag"))
        return rows.join(by, rows[_ID].eqNullSafe(by["id"]) & (rows[_TAG] == by["tag"]), how)

    rows = docs.withColumns({_ID: F.col(doc_id).cast("long"), _TAG: tag})
    out = match(rows, keys.filter("NOT kept").distinct(), "left_anti")
    twice = keys.filter("kept").groupBy(_ID, _TAG).count().filter("count > 1")
    if one and not twice.isEmpty():
        out = match(out, twice, "left_anti").unionByName(match(out, twice, "left_semi").dropDuplicates([_ID, _TAG]))
    return out.drop(_ID, _TAG)
