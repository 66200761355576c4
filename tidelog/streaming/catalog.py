"""The catalogue as a stream: each micro-batch of log entries is one step of the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.journal import change_set, latest


def log_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_latest(log: DataFrame, path: str = "path", seq: str = "seq") -> DataFrame:
    """The last entry of each path as streaming state: order is by seq, not by arrival, so late entries do no harm."""
    rest = [c for c in log.columns if c != path]
    last = log.groupBy(path).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.select(path, *(F.col(f"_last.{c}").alias(c) for c in rest))


def stream_new_fragments(fragments: DataFrame, key: str = "sha1", time: str | None = None, keep: str = "1 day") -> DataFrame:
    """One of each fragment. With an event time, a hash is forgotten `keep` after the newest one seen, so state stays bounded."""
    if time is None:
        return fragments.dropDuplicates([key])
    return fragments.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def stream_changes(trees: DataFrame, same: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is a whole tree; what it changes against the one before goes to target/batch=<n>: path, status.

    A batch's folders are overwritten if it runs again. Of the trees kept beside the target, only the last two stay.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, f"{target}_trees"
        batch.write.mode("overwrite").parquet(f"{state}/tree={number}")
        new = spark.read.schema(batch.schema).parquet(f"{state}/tree={number}")
        old = spark.read.schema(batch.schema).parquet(f"{state}/tree={number - 1}") if number else new.limit(0)
        change_set(old, new, same).write.mode("overwrite").parquet(f"{target}/batch={number}")
        _forget(spark, f"{state}/tree={number - 2}")

    return trees.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stream_windows(events: DataFrame, time: str, late: str, window: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window; rows later than `late` are dropped by the watermark, as streams define it."""
    own = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(own.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "n")


def maintain(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest entry of each path in target/state=<batch>: each batch merges with the state before it.

    A batch's folder is overwritten if the batch runs again, so the result is the same after a failure. States before the
    last two are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = spark.read.schema(batch.schema).parquet(f"{target}/state={number - 1}").unionByName(batch)
        latest(batch).select(*log.columns).write.mode("overwrite").parquet(f"{target}/state={number}")
        _forget(spark, f"{target}/state={number - 2}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it has put out, from a memory table: for reports and tests."""
    out = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    out.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
