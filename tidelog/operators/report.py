"""Listings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.scalar import extension, file_name
from tidelog.operators.compare import ancestors


def version_info(versions: DataFrame, total: bool = False) -> DataFrame:
    """ver, updates, deletes, csize; with a total line (null ver) if asked for."""
    sums = [F.sum("updates").alias("updates"), F.sum("deletes").alias("deletes"), F.sum("csize").alias("csize")]
    return (versions.rollup("ver") if total else versions.groupBy("ver")).agg(*sums)


def last_versions(df: DataFrame, k: int) -> DataFrame:
    """Rows of the last k versions that occur. The distinct versions are ranked, not the rows."""
    keep = df.select("ver").distinct().orderBy(F.desc("ver")).limit(k)
    return df.join(keep, "ver", "left_semi")


def duplicate_groups(tree: DataFrame, hash_: str = "sha1") -> DataFrame:
    """Contents that occur more than once: hash, copies, first path, bytes that could be saved."""
    groups = tree.groupBy(hash_).agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"), F.first("size").alias("size"))
    return groups.filter("copies > 1").withColumn("wasted", (F.col("copies") - 1) * F.col("size")).drop("size")


def keep_first(tree: DataFrame, hash_: str = "sha1") -> DataFrame:
    """One file of each content, the least path."""
    return tree.groupBy(hash_).agg(F.min_by(F.struct(*[c for c in tree.columns if c != hash_]), "path").alias("_f")).select(hash_, "_f.*").select(*tree.columns)


def folder_sizes(tree: DataFrame) -> DataFrame:
    """Files and bytes of each folder on the first level; files without a folder count under an empty name."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    return tree.groupBy(top.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def folder_sizes_all(tree: DataFrame) -> DataFrame:
    """Files and bytes at any depth below each folder. Sizes are summed by folder first, so folders explode, not files."""
    own = tree.withColumn("_dir", F.regexp_extract("path", "(?s)^(.*/)", 1)).groupBy("_dir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    every = ancestors(own.filter("_dir <> ''").withColumn("path", F.concat("_dir", F.lit("x"))))
    return every.groupBy("folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


_KEYS = {"name": lambda: file_name(F.col("path")), "ext": lambda: extension(F.col("path"))}


def ordered(df: DataFrame, keys: str, desc: bool = False) -> DataFrame:
    """Order by "ext;name" and the like; any other key is a column. Ties go by path."""
    columns = [_KEYS[k]() if k in _KEYS else F.col(k) for k in keys.split(";") if k]
    return df.orderBy(*(c.desc() if desc else c.asc() for c in columns), "path")


def newest(tree: DataFrame, n: int, time: str = "mtime") -> DataFrame:
    """The newest n files: a top-n, which each task cuts down on its own first."""
    return tree.orderBy(F.desc(time), "path").limit(n)


def last_rows(df: DataFrame, order: str, by: str, n: int = 2) -> DataFrame:
    own = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("from_last", F.row_number().over(own)).filter(F.col("from_last") <= n)


def occurrences(text: Column, find: str) -> Column:
    """How often a string stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("long")


def count_string(docs: DataFrame, find: str, expected: int, content: str = "content") -> DataFrame:
    found = F.coalesce(F.sum(occurrences(F.col(content), find)), F.lit(0)).cast("long")
    return docs.agg(found.alias("found"), (found == expected).alias("ok"))


def collisions(files: DataFrame, weak: str, strong: str) -> DataFrame:
    """Values of the weak hash that stand for more than one content."""
    pairs = files.groupBy(weak, strong).agg(F.count(F.lit(1)).alias("files"))
    return pairs.groupBy(weak).agg(F.count(F.lit(1)).alias("contents"), F.sum("files").alias("files")).filter("contents > 1")


def summary(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def csv_lines(df: DataFrame, columns: list[str], sep: str = ";", header: str | None = None, footer: str | None = None) -> DataFrame:
    """line, and with a header or footer text place (0, 1, 2) to order by. \\t as a separator is a tab."""
    sep = "\t" if sep == "\\t" else sep
    lines = df.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))
    if header is None and footer is None:
        return lines
    ends = [(text, place) for text, place in ((header, 0), (footer, 2)) if text is not None]
    return lines.withColumn("place", F.lit(1)).unionByName(df.sparkSession.createDataFrame(ends, "line string, place int"))


def errors_by_code(log: DataFrame, code: str = "code") -> DataFrame:
    """How often each error code came, and its first and last place."""
    return log.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def block_memory(blocks: DataFrame, by: str | None = None, usize: str = "usize") -> DataFrame:
    """The most memory that extracting any one block takes, and the sum over all."""
    return blocks.groupBy(*([by] if by else [])).agg(F.max(usize).alias("most"), F.sum(usize).alias("total"), F.count(F.lit(1)).alias("blocks"))


def spread(df: DataFrame, value: str, by: str, shares=(0.25, 0.5, 0.9)) -> DataFrame:
    """Exact percentiles of a value by group."""
    return df.groupBy(by).agg(*(F.percentile(value, F.lit(q)).alias(f"p{round(100 * q)}") for q in shares))


def running_total(rows: DataFrame, order: str, value: str, name: str = "before", ranges: int = 64) -> DataFrame:
    """Adds the sum of value over all rows before each in order. Ranges of the order run side by side: approximate quantiles
    place the cuts, each range's total is one row, and a window runs within a range only."""
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    number = sum(((F.col(order) >= F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    numbered = rows.withColumn("_range", F.coalesce(number, F.lit(0)))
    totals = numbered.groupBy("_range").agg(F.sum(value).alias("_total"))
    earlier = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = numbered.withColumn("_own", F.coalesce(own, F.lit(0))).join(F.broadcast(earlier), "_range")
    return out.select(*rows.columns, (F.col("_base") + F.col("_own")).alias(name))


def volumes(parts: DataFrame, size: int, order: str = "offset", length: str = "size") -> DataFrame:
    """Number of the fixed-size volume that each part starts in."""
    placed = running_total(parts, order, length, "_before")
    return placed.withColumn("volume", (F.floor(F.col("_before") / size) + 1).cast("long")).drop("_before")


def listing(tree: DataFrame, columns: list[str]) -> DataFrame:
    return tree.select(*columns).orderBy("path")


def positions(rows: DataFrame, name: str = "n") -> DataFrame:
    """Ordered rows with their position from 1: each partition counts on from those before it, so no task has all rows."""
    out = rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    return rows.sparkSession.createDataFrame(out, rows.schema.add(name, "long"))
