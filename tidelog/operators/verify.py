"""Integrity checks: hashes of fragments, files from fragments, CRC-32 from parts, block order, failed extractions."""

from __future__ import annotations

import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fragment_check(fragments: DataFrame, content: str = "content", stored: str = "sha1") -> DataFrame:
    return fragments.withColumn("ok", F.sha1(F.col(content).cast("binary")).eqNullSafe(F.col(stored)))


def rebuilt(fragments: DataFrame, order: str = "part", content: str = "chunk", key: str = "path") -> DataFrame:
    """Files put together from their fragments in order: key, content. A file is one row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c"))))
    return fragments.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("content"))


def rebuild_check(files: DataFrame, fragments: DataFrame, key: str = "path") -> DataFrame:
    """Whether each file with a stored sha1 is what its fragments make."""
    back = rebuilt(fragments, key=key).select(key, F.sha1(F.col("content").cast("binary")).alias("rebuilt_sha1"))
    return files.join(back, key, "left").select(key, F.coalesce(F.col("rebuilt_sha1"), F.sha1(F.lit("").cast("binary"))).eqNullSafe(F.col("sha1")).alias("ok"))


def block_faults(blocks: DataFrame) -> DataFrame:
    """Blocks that are empty, start below 1, or start or lie before the end of the one before: block_id, fault."""
    order = Window.orderBy("start", "block_id")
    end, place = F.lag(F.col("start") + F.col("frags")).over(order), F.lag(F.col("offset") + F.col("bsize")).over(order)
    fault = F.when(F.col("start") < 1, "bad start").when(F.col("frags") < 1, "empty").when(F.col("start") < end, "overlap").when(F.col("offset") < place, "order")
    return blocks.withColumn("fault", fault).filter("fault IS NOT NULL").select("block_id", "fault")


def block_check(blocks: DataFrame, fragments: int) -> DataFrame:
    """The first structural fault of each block, in order of block_id; fragments: how many there are.

    Blocks are some millions at most, a row for each; the window over them is split at no key but theirs.
    """
    order = Window.orderBy("block_id")
    start, place = F.lag("start").over(order), F.lag(F.col("offset") + F.col("bsize")).over(order)
    fault = (
        F.when(F.col("bsize") < 0, "negative block size")
        .when(F.col("start") < 1, "block starts at fragment 0")
        .when(F.col("start") > fragments, "block start too high")
        .when(F.col("start") < start, "unordered frags")
        .when(F.col("start") == start, "empty block")
        .when(F.col("offset") < place, "unordered blocks")
    )
    return blocks.withColumn("fault", fault).filter("fault IS NOT NULL").select("block_id", "fault")


def three_way(stored: DataFrame, recomputed: DataFrame, reread: DataFrame, hash_: str = "sha1", key: str = "path") -> DataFrame:
    """key, and whether the stored hash, the one of what the archive holds, and the one of the files agree (null: not there)."""
    a, b, c = (df.select(F.col(key), F.col(hash_).alias(n)) for df, n in ((stored, "_stored"), (recomputed, "_made"), (reread, "_read")))
    all_ = a.join(b, key, "full_outer").join(c, key, "full_outer")
    return all_.select(key, (F.col("_stored") == F.col("_made")).alias("archive_ok"), (F.col("_stored") == F.col("_read")).alias("file_ok"))


def quick_test(entries: DataFrame, tree: DataFrame, key: str = "path") -> DataFrame:
    """Size and date only: key and whether both are as the entry has them; null where there is no file."""
    a, b = entries.select(key, "size", "mtime").alias("a"), tree.select(key, "size", "mtime").alias("b")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime") == F.col("b.mtime"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(F.col(f"a.{key}").alias(key), same.alias("ok"))


def packed_sizes(blocks: DataFrame, versions: DataFrame, bsize: str = "bsize", csize: str = "csize") -> DataFrame:
    """One row: bytes of all blocks, bytes that the versions' heads claim, and whether they agree."""
    held, claimed = blocks.agg(F.sum(bsize).alias("dhsize")), versions.agg(F.sum(csize).alias("dcsize"))
    both = held.unionByName(claimed, allowMissingColumns=True).agg(F.max("dhsize").alias("dhsize"), F.max("dcsize").alias("dcsize"))
    return both.withColumn("ok", F.col("dhsize").eqNullSafe(F.col("dcsize")))


def global_hash(parts: DataFrame, order: str = "part", hash_: str = "sha1", groups: int = 4096) -> DataFrame:
    """One hash over all parts, our own definition: SHA-256 over the SHA-256 of each run of `groups` parts' hashes, in order.

    Where there are more than `groups` runs, runs of runs are hashed first: a tree, so no task joins more than `groups` hashes.
    runs is the number on the first level.
    """

    def joined(o: str, h: str):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(h).alias("h"))))
        return F.sha2(F.array_join(F.transform(pairs, lambda x: x["h"]), "").cast("binary"), 256)

    level = parts.groupBy(F.floor(F.col(order) / groups).alias("run")).agg(joined(order, hash_).alias("h")).withColumn("n", F.lit(1).cast("long"))
    top = (parts.agg(F.max(order)).first()[0] or 0) // groups
    while top >= groups:
        upper = F.floor(F.col("run") / groups).alias("run")
        level, top = level.groupBy(upper).agg(joined("run", "h").alias("h"), F.sum("n").alias("n")), top // groups
    return level.agg(joined("run", "h").alias("sha256"), F.sum("n").alias("runs"))


def extraction_report(refs: DataFrame, done: DataFrame, by: str = "path") -> DataFrame:
    """Files of which not all fragments were extracted: by, extracted, total."""
    got = refs.join(done.select("frag_id", F.lit(1).alias("_ok")), "frag_id", "left")
    return got.groupBy(by).agg(F.count("_ok").alias("extracted"), F.count(F.lit(1)).alias("total")).filter("extracted < total")


def index_check(blocks: DataFrame, content: str = "content") -> DataFrame:
    """Size and SHA-1 of stored index blocks against what they hold."""
    body = F.col(content).cast("binary")
    return blocks.select("block_id", (F.octet_length(content) == F.col("usize")).alias("size_ok"), F.sha1(body).eqNullSafe(F.col("sha1")).alias("sha1_ok"))


def _times(matrix, vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache(1024)
def _zeros(length: int) -> tuple[int, ...]:
    """The matrix over bits that appends `length` zero bytes to a CRC."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [_times(step, row) for row in step]
    out = [1 << i for i in range(32)]
    while length:
        if length & 1:
            out = [_times(step, row) for row in out]
        length >>= 1
        step = [_times(step, row) for row in step]
    return tuple(out)


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of two pieces put together, from their CRCs and the second one's length: first times x^(8 length), plus second."""
    return _times(_zeros(length), first) ^ second


def crc32_of_parts(parts: DataFrame, order: str = "part", content: str = "chunk", key: str = "path") -> DataFrame:
    """key, crc32 of each whole file, put together from its parts' CRCs; only those are shuffled."""
    small = parts.select(key, F.col(order).alias("o"), F.crc32(F.col(content).cast("binary")).alias("crc"), F.octet_length(content).cast("long").alias("len"))

    @F.pandas_udf("long")
    def folded(pieces: pd.Series) -> pd.Series:
        def one(rows):
            crc = 0
            for x in rows:
                crc = crc32_combine(crc, x["crc"], x["len"])
            return crc

        return pieces.map(one)

    lists = small.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "crc", "len"))).alias("pieces"))
    return lists.select(key, folded("pieces").alias("crc32"))


def crc32_direct(data: bytes) -> int:
    return zlib.crc32(data)
