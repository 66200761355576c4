"""The change log: versions, prefixes of it, and the state of the tree that it leaves.

A log has seq (order), ver, path, deleted and other columns. Later entries of a path replace earlier ones; a tombstone stays
and hides what came before, and is left out only when the tree is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, path: str = "path", seq: str = "seq") -> DataFrame:
    """The last entry of each path, tombstones included. seq is unique in a path, so its greatest value finds the entry.

    The greatest values come from a hash aggregation over two columns; then a hash semi-join, for an aggregation that
    carries whole entries would sort them, as Spark's hash tables hold no strings.
    """
    last = log.groupBy(F.col(path).alias("_path")).agg(F.max(seq).alias("_seq")).hint("shuffle_hash")
    out = log.join(last, (log[path] == last["_path"]) & (log[seq] == last["_seq"]), "left_semi")
    return out.select(path, *(c for c in log.columns if c != path))


def snapshot(log: DataFrame, path: str = "path", seq: str = "seq") -> DataFrame:
    return latest(log, path, seq).filter(f"NOT deleted AND {path} <> ''")


def until_version(log: DataFrame, ver: int) -> DataFrame:
    """The first `ver` versions; a negative number counts from the last one."""
    return log.filter(F.col("ver") <= ver) if ver >= 0 else _cut(log, log.agg(F.max("ver") + 1 + ver))


def _cut(log: DataFrame, stop: DataFrame) -> DataFrame:
    """Versions before stop, a table of one number; all if it is null. The number is taken first, so that the cut is a
    literal filter, which reaches the scan and prunes the catalogue's folders."""
    first = stop.first()[0]
    return log if first is None else log.filter(F.col("ver") < F.lit(first))


def until_date(log: DataFrame, versions: DataFrame, date) -> DataFrame:
    """The log up to the first version that is later than date: a prefix, even where later versions have earlier dates."""
    return _cut(log, versions.filter(F.col("date") > F.lit(date)).agg(F.min("ver")))


def complete(log: DataFrame, versions: DataFrame) -> DataFrame:
    """The log before the first incomplete version (negative csize)."""
    return _cut(log, versions.filter("csize < 0").agg(F.min("ver")))


def version_range(log: DataFrame, first: int | None = None, last: int | None = None, tail: int | None = None) -> DataFrame:
    if tail is not None:
        top = log.agg(F.max("ver")).first()[0]
        return log if top is None else log.filter(F.col("ver") > F.lit(top - int(tail)))
    if first is not None:
        log = log.filter(F.col("ver") >= first)
    return log if last is None else log.filter(F.col("ver") <= last)


def crop_bytes(versions: DataFrame, most: int) -> DataFrame:
    """The longest prefix of versions whose csize adds up to at most `most`. One row a version."""
    total = F.sum("csize").over(Window.orderBy("ver"))
    return versions.withColumn("total", total).filter(F.col("total") <= most)


def history(log: DataFrame, width: int = 4) -> DataFrame:
    """Every entry under its version's folder."""
    number = F.col("ver").cast("string")
    return log.withColumn("path", F.concat(F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0")), F.lit("/"), F.col("path")))


def version_table(log: DataFrame, size: str = "size") -> DataFrame:
    """ver, date, lastdate, updates, deletes, csize; counters are over the whole log, whatever is selected later."""
    dates = F.min("mtime").alias("date"), F.max("mtime").alias("lastdate")
    counts = F.count_if(~F.col("deleted")).alias("updates"), F.count_if("deleted").alias("deletes")
    return log.groupBy("ver").agg(*dates, *counts, F.sum(size).alias("csize"))


def numbered(blocks: DataFrame, offset: str = "offset") -> DataFrame:
    """Version numbers by place in the archive. One row a version."""
    return blocks.withColumn("ver", F.row_number().over(Window.orderBy(offset)))


def first_fragments(versions: DataFrame, count: str = "fragments") -> DataFrame:
    """First fragment id of each version, from running counts."""
    before = F.coalesce(F.sum(count).over(Window.orderBy("ver").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return versions.withColumn("first_fragment", before + 1)


def version_changes(log: DataFrame, value: str = "size") -> DataFrame:
    """Per entry: added, modified, same or deleted against the path's entry before."""
    order = Window.partitionBy("path").orderBy("seq")
    gone, old = F.lag("deleted").over(order), F.lag(value).over(order)
    change = F.when(F.col("deleted"), "deleted").when(gone.isNull() | gone, "added").when(F.col(value).eqNullSafe(old), "same").otherwise("modified")
    return log.withColumn("change", change)


def change_set(old: DataFrame, new: DataFrame, same: list[str], always: Column | None = None, tombstones: bool = True) -> DataFrame:
    """What a new version must record: path and added, changed or deleted. same: columns that must be equal for no change."""
    a, b = old.alias("a"), new.alias("b")
    differs = ~F.struct(*(F.col(f"a.{c}") for c in same)).eqNullSafe(F.struct(*(F.col(f"b.{c}") for c in same)))
    if always is not None:
        differs = differs | always
    path = F.coalesce("a.path", "b.path")
    status = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "deleted").when(differs, "changed")
    out = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(path.alias("path"), status.alias("status")).filter("status IS NOT NULL")
    return out if tombstones else out.filter("status <> 'deleted'")
