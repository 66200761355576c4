"""Trees against trees: comparison, synchronisation plans, duplicates between folders. All are equi-joins on path or content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.scalar import file_name


def compare(left: DataFrame, right: DataFrame, quick: bool = False, key: str = "path") -> DataFrame:
    """path, status: equal, changed, missing (only left) or new (only right). Trees have path, size and sha1; quick compares sizes."""
    a, b = left.alias("a"), right.alias("b")
    same = F.col("a.size").eqNullSafe(F.col("b.size"))
    if not quick:
        same = same & F.col("a.sha1").eqNullSafe(F.col("b.sha1"))
    status = F.when(F.col(f"b.{key}").isNull(), "missing").when(F.col(f"a.{key}").isNull(), "new").when(same, "equal").otherwise("changed")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"))


def sync(left: DataFrame, right: DataFrame, quick: bool = False) -> DataFrame:
    """Only what differs."""
    return compare(left, right, quick).filter("status <> 'equal'")


def verify(archive: DataFrame, tree: DataFrame) -> DataFrame:
    """Every entry of the archive: ok, different or missing in the tree."""
    return compare(archive, tree).filter("status <> 'new'").withColumn("status", F.when(F.col("status") == "equal", "ok").when(F.col("status") == "changed", "different").otherwise("missing"))


def compare_many(master: DataFrame, slaves: dict[str, DataFrame], quick: bool = False) -> DataFrame:
    """compare() of the master with each slave, with the slave's name. One join for all: slaves are stacked first."""
    stacked = reduce(DataFrame.unionByName, [df.select("path", "size", "sha1").withColumn("slave", F.lit(n)) for n, df in slaves.items()])
    each = F.explode(F.array(*(F.lit(n) for n in slaves)))
    a, b = master.select("path", "size", "sha1", each.alias("slave")).alias("a"), stacked.alias("b")
    same = F.col("a.size").eqNullSafe(F.col("b.size"))
    if not quick:
        same = same & F.col("a.sha1").eqNullSafe(F.col("b.sha1"))
    status = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "new").when(same, "equal").otherwise("changed")
    on = (F.col("a.path") == F.col("b.path")) & (F.col("a.slave") == F.col("b.slave"))
    return a.join(b, on, "full_outer").select(F.coalesce("a.slave", "b.slave").alias("slave"), F.coalesce("a.path", "b.path").alias("path"), status.alias("status"))


def doubled(first: DataFrame, second: DataFrame, by_hash: bool = False) -> DataFrame:
    """Files of the second tree that the first has: by content, or by file name."""
    if by_hash:
        return second.join(first.select("sha1").distinct(), "sha1", "left_semi")
    names = first.select(file_name(F.col("path")).alias("name")).distinct()
    return second.withColumn("name", file_name(F.col("path"))).join(names, "name", "left_semi").drop("name")


def extra(tree: DataFrame, archive: DataFrame) -> DataFrame:
    """What the archive hasn't: to be deleted by a purge."""
    return tree.join(archive.select("path"), "path", "left_anti")


def mirror_plan(master: DataFrame, slave: DataFrame, kill: bool = False) -> DataFrame:
    """path, action: copy, update, and with kill delete."""
    action = F.when(F.col("status") == "missing", "copy").when(F.col("status") == "changed", "update").when(F.col("status") == "new", "delete")
    out = compare(master, slave).withColumn("action", action).filter("action IS NOT NULL").drop("status")
    return out if kill else out.filter("action <> 'delete'")


def ancestors(df: DataFrame, path: str = "path") -> DataFrame:
    """Each folder above each path, with a slash at its end."""
    parts = F.split(F.regexp_replace(path, "/$", ""), "/")
    n = F.size(parts)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return df.select("*", F.explode(above).alias("folder"))


def empty_dirs(tree: DataFrame) -> DataFrame:
    """Folders (paths with a slash at the end) that have no file at any depth."""
    files = tree.filter("NOT endswith(path, '/')")
    return tree.filter("endswith(path, '/')").join(ancestors(files).select(F.col("folder").alias("path")).distinct(), "path", "left_anti")


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def part_gaps(parts: DataFrame, part: str = "part") -> DataFrame:
    """Numbers that are missing between 1 and the largest part. Self-contained: numbers come from a range, not from pairs."""
    top = parts.agg(F.max(part).alias("top")).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias(part))
    return top.join(parts.select(F.col(part).cast("long").alias(part)), part, "left_anti")


def compare_fragments(archive: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """path, equal: entries with size and an ordered list of fragment hashes, against files of the same form.

    Both absent is no row; a folder (a path with a slash at its end) is equal if it is on both sides; otherwise the size
    decides first, then the hashes in order, so trailing bytes make a file different.
    """
    a, b = archive.alias("a"), files.alias("b")
    both = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.hashes").eqNullSafe(F.col("b.hashes"))
    path = F.coalesce(f"a.{key}", f"b.{key}")
    equal = both & (path.endswith("/") | same)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(path.alias(key), equal.alias("equal"))


def transfer_plan(local: DataFrame, remote: DataFrame, quick: str = "quick") -> DataFrame:
    """path, action of an append-only transfer: send what the remote side has not, append to what it has the start of (less
    bytes), keep what has the same size and quick hash, and report as conflict what differs otherwise. Nothing is deleted."""
    a, b = local.alias("a"), remote.alias("b")
    same = (F.col("a.size") == F.col("b.size")) & (F.col(f"a.{quick}") == F.col(f"b.{quick}"))
    action = F.when(F.col("b.path").isNull(), "send").when(same, "keep").when(F.col("b.size") < F.col("a.size"), "append").otherwise("conflict")
    return a.join(b, F.col("a.path") == F.col("b.path"), "left").select(F.col("a.path").alias("path"), action.alias("action"))
