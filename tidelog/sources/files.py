"""Sources and sinks: file trees, multipart files, lists, catalogue tables, and tagged blocks in foreign blobs."""

from __future__ import annotations

import os
import re
import subprocess
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.selection import selected


def tree(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None, content: bool = True) -> DataFrame:
    """path, size, mtime (and content, sha1) of files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(path)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return found.select(*columns, "content", F.sha1("content").alias("sha1")) if content else found.select(*columns)


def part_glob(name: str) -> str:
    """A multipart name's glob: * is the number, each ? one digit of it."""
    return re.sub(r"\?+", lambda m: "[0-9]" * len(m[0]), name.replace("*", "[0-9]*"))


def multipart(spark: SparkSession, name: str) -> DataFrame:
    """part, content, offset of the parts 1, 2, ... until the first that is missing."""
    regex = "".join("([0-9]+)" if c == "*" else c if c == "\0" else re.escape(c) for c in re.sub(r"\?+", "*", name.rsplit("/", 1)[-1]))
    found = spark.read.format("binaryFile").load(part_glob(name))
    parts = found.select(F.regexp_extract("path", f"{regex}$", 1).cast("long").alias("part"), F.col("length").alias("size"), "content")
    order = Window.orderBy("part")
    whole = parts.withColumn("_n", F.row_number().over(order)).filter("_n = part").drop("_n")
    return whole.withColumn("offset", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def seek(parts: DataFrame, offset: int) -> DataFrame:
    """Part and place within it of an offset in all parts together."""
    return parts.filter((F.col("offset") <= offset) & (F.lit(offset) < F.col("offset") + F.col("size"))).select("part", (F.lit(offset) - F.col("offset")).alias("place"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def tag_places(data: bytes | None, tag: bytes) -> list[int]:
    """All byte offsets of a tag, overlapping ones too."""
    out, at = [], (data or b"").find(tag)
    while at >= 0:
        out.append(at)
        at = data.find(tag, at + 1)
    return out


def find_tag(blobs: DataFrame, tag: bytes, content: str = "content") -> DataFrame:
    """Adds tag_at: byte offsets (from 0) of a tag in each blob, by a search of bytes in Arrow batches."""
    if not tag:
        raise ValueError("an empty tag is everywhere")

    @F.pandas_udf("array<long>")
    def places(data: pd.Series) -> pd.Series:
        return data.map(lambda x: tag_places(x, tag))

    return blobs.withColumn("tag_at", places(F.col(content).cast("binary")))


def payload(blobs: DataFrame, tag: bytes, within: int = 3 << 20, content: str = "content") -> DataFrame:
    """Adds payload: what stands behind the last tag that begins in the first `within` bytes; null where there is none."""
    found = find_tag(blobs, tag, content)
    near = F.array_max(F.filter("tag_at", lambda p: p < within))
    start = (near + len(tag) + 1).cast("int")
    return found.withColumn("payload", F.when(near.isNotNull(), F.substr(F.col(content), start, F.lit(2147483647)))).drop("tag_at")


def listed(tree: DataFrame, list_: DataFrame, path: str = "path") -> DataFrame:
    """Files that a path list names; one that names a folder means all below it."""
    every = tree.withColumn("_above", F.array_union(F.array(path), _folders(F.col(path))))
    names = list_.select(F.regexp_replace(path, "/$", "").alias("_name")).distinct()
    wanted = every.select(path, F.explode("_above").alias("_name")).join(names, "_name", "left_semi").select(path).distinct()
    return tree.join(wanted, path, "left_semi")


def _folders(path):
    parts = F.split(path, "/")
    upto = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.transform(upto, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def write_files(files: DataFrame, target: str) -> DataFrame:
    """Writes path and content (and mtime, if there is one) as files below target, a folder that all executors share; parents
    are made. A file is written beside its place and then renamed, so none is seen half, and a task that runs again replaces it.
    Returns path, bytes, error: what became of each. A path that leaves the target is an error.
    """
    dated = "mtime" in files.columns

    def run(batches):
        for batch in batches:
            out = {"path": [], "bytes": [], "error": []}
            for row in batch.to_pylist():
                error, data = None, row["content"] or b""
                place = os.path.normpath(os.path.join(target, (row["path"] or "").lstrip("/")))
                try:
                    if not place.startswith(os.path.normpath(target) + os.sep):
                        raise OSError("the path leaves the target")
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    part = f"{place}.{uuid.uuid4().hex}.tmp"
                    with open(part, "wb") as f:
                        f.write(data)
                    if dated and row["mtime"] is not None:
                        os.utime(part, (row["mtime"] / 1e6,) * 2)
                    os.replace(part, place)
                except OSError as e:
                    error = str(e)
                for name, value in zip(out, (row["path"], len(data) if error is None else None, error), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("error", pa.string())]))

    columns = ["path", F.col("content").cast("binary").alias("content"), *([F.unix_micros("mtime").alias("mtime")] if dated else [])]
    return files.select(*columns).mapInArrow(run, "path string, bytes long, error string")


def piped(rows: DataFrame, command: list[str], value: str = "content", name: str = "output") -> DataFrame:
    """Adds what a command puts out for each row's value, given on its standard input; null where it fails."""

    @F.pandas_udf("string")
    def ran(values: pd.Series) -> pd.Series:
        def one(x):
            done = subprocess.run(command, input=(x or "").encode(), capture_output=True, check=False)
            return done.stdout.decode(errors="replace") if done.returncode == 0 else None

        return values.map(one)

    return rows.withColumn(name, ran(F.col(value).cast("string")))


def database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


#: Schemas that a dump leaves out unless it is told otherwise.
SYSTEM_DATABASES = ("information_schema", "performance_schema", "mysql", "sys")


def chosen_databases(names: DataFrame, only=(), not_=(), name: str = "name") -> DataFrame:
    """Databases to dump: without the system's own, in only (if given) and not in not_, by globs."""
    return names.filter(~F.lower(name).isin(*SYSTEM_DATABASES)).filter(selected(F.col(name), (), only, not_))


def append_version(log: DataFrame, path: str, ver: int) -> None:
    """Adds a version to a catalogue: a folder of its own, committed as a whole."""
    log.withColumn("ver", F.lit(ver)).write.mode("append").partitionBy("ver").parquet(path)


def catalog(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """A catalogue's log; a version cut prunes folders. Columns that later versions added are null in earlier ones."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    return found if until is None else found.filter(F.col("ver") <= until)


def export_csv(df: DataFrame, path: str, sep: str = ";", header: bool = True) -> None:
    df.write.option("sep", sep).option("header", str(header).lower()).csv(path)


def export_text(df: DataFrame, path: str, append: bool = False) -> None:
    df.select(F.concat_ws("\t", *df.columns).alias("value")).write.mode("append" if append else "errorifexists").text(path)


def errors(df: DataFrame, bad, path: str) -> DataFrame:
    """Writes rows that `bad` marks to an error table and returns the others."""
    df.filter(bad).write.mode("append").parquet(path)
    return df.filter(~F.coalesce(bad, F.lit(False)))


def non_zero(fragments: DataFrame, content: str = "content") -> DataFrame:
    """Fragments that a sparse write must store: not all zero bytes, or the file's last."""
    last = F.max("part").over(Window.partitionBy("path"))
    return fragments.withColumn("_last", last).filter(~F.hex(content).rlike("^(00)*$") | (F.col("part") == F.col("_last"))).drop("_last")
