"""Fragments and blocks: sizes, containing blocks, runs, chunking, and dedup of chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_sizes(files: DataFrame, refs: DataFrame, fragments: DataFrame, key: str = "path") -> DataFrame:
    """A file's size is the sum of its fragments', unknown if one is; ids that there are no fragments for are passed over."""
    known = refs.select(key, "frag_id").join(fragments.select("frag_id", "usize"), "frag_id")
    sums = known.groupBy(key).agg(F.sum("usize").alias("total"), F.bool_or(F.col("usize").isNull()).alias("unknown"))
    size = F.when(F.col("unknown"), F.lit(None)).otherwise(F.coalesce("total", F.lit(0)))
    return files.join(sums, key, "left").select(key, size.cast("long").alias("size"))


def to_blocks(refs: DataFrame, blocks: DataFrame, runs: int = 1) -> DataFrame:
    """refs with block_id and start of the block that holds frag_id: by its count of fragments (frags), or without one the last
    block that starts at or before it.

    Blocks are consecutive ranges of ids, so a block's number of widths is bounded: each block is exploded to the `width`-aligned
    cells that it touches, refs join on their cell, and a range condition picks within the cell. No join without an equality.
    """
    width = 1024
    if "frags" in blocks.columns:
        ranges = blocks.filter("frags > 0").withColumn("next_start", F.col("start") + F.col("frags"))
        top = F.col("next_start") - 1
    else:
        ranges = blocks.withColumn("next_start", F.lead("start").over(Window.orderBy("start")))
        most = F.lit(refs.agg(F.max("frag_id")).first()[0])
        top = F.coalesce(F.col("next_start") - 1, F.greatest(F.col("start"), most))
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(top / width))))
    cells = ranges.select("block_id", "start", "next_start", "cell")
    inside = (F.col("frag_id") >= F.col("start")) & (F.col("next_start").isNull() | (F.col("frag_id") < F.col("next_start")))
    return refs.withColumn("cell", F.floor(F.col("frag_id") / width)).join(cells, "cell").filter(inside).drop("cell", "next_start")


def block_sizes(fragments: DataFrame, by: str = "block_id") -> DataFrame:
    """Size of each block's data with its table: 8 bytes, and 4 for each fragment."""
    return fragments.groupBy(by).agg((F.lit(8) + F.sum(F.col("usize") + 4)).alias("usize"), F.count(F.lit(1)).alias("frags"))


def offsets(refs: DataFrame, order: list[str], by: str = "path") -> DataFrame:
    """Each fragment's offset within its file: the sum of those before it."""
    before = F.sum("usize").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return refs.withColumn("frag_offset", F.coalesce(before, F.lit(0)))


def _writes(most: int, columns: list[str]):
    """Numbers the writes within runs that arrive sorted: a fragment that would take a write above `most` bytes begins another."""

    def run(batches):
        at, total, cut = None, 0, 0
        for batch in batches:
            cuts = []
            for *key, size in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if key != at:
                    at, total, cut = key, 0, 0
                elif total + size > most:
                    total, cut = 0, cut + 1
                total += size
                cuts.append(cut)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.int64())], names=[*batch.schema.names, "cut"])

    return run


def runs(refs: DataFrame, order: list[str], by: str = "path", block: str = "block_id", most: int = 0x7FFFFFFF) -> DataFrame:
    """Consecutive fragment ids of one block, in the order of the file, as one write of at most `most` bytes (or one larger
    fragment): by, run, block, first_frag, frags, bytes. Only runs above it leave the JVM, in order, to be cut.
    """
    own = Window.partitionBy(by).orderBy(*order)
    new = F.coalesce(((F.col("frag_id") != F.lag("frag_id").over(own) + 1) | (F.col(block) != F.lag(block).over(own))), F.lit(True))
    islands = refs.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(own))
    islands = islands.select(by, "run", block, "frag_id", F.col("usize").cast("long").alias("usize"))
    sums = F.min(block).alias(block), F.min("frag_id").alias("first_frag"), F.count(F.lit(1)).alias("frags"), F.sum("usize").alias("bytes")
    whole = islands.groupBy(by, "run").agg(*sums)
    fine = whole.filter(F.col("bytes").isNull() | (F.col("bytes") <= most))
    large = whole.filter(F.col("bytes") > most).select(by, "run")
    parts = islands.join(large, [by, "run"], "left_semi").filter("usize IS NOT NULL").repartition(by, "run").sortWithinPartitions(by, "run", "frag_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", cut long"
    cut = parts.mapInArrow(_writes(most, [by, "run", "usize"]), schema).groupBy(by, "run", "cut").agg(*sums).drop("cut")
    return fine.unionByName(cut)


def fixed_chunks(docs: DataFrame, size: int, content: str = "content", key: str = "path") -> DataFrame:
    """key, part (from 0) and chunk: runs of `size` characters. Linear in the text's length."""
    parts = F.regexp_extract_all(content, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select(key, F.posexplode(parts).alias("part", "chunk"))


def dedup_ratio(chunks: DataFrame, hash_: Column, size: Column) -> DataFrame:
    """One row: chunks, distinct chunks, bytes, distinct bytes, ratio."""
    each = chunks.groupBy(hash_.alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.first(size).cast("long").alias("size"))
    total, kept = F.sum(F.col("n") * F.col("size")), F.sum("size")
    return each.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), total.alias("bytes"), kept.alias("distinct_bytes"), F.round(total / kept, 6).alias("ratio"))


def new_fragments(incoming: DataFrame, known: DataFrame, key: str = "sha1") -> DataFrame:
    """Incoming fragments that aren't known yet, one of each."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def needed_blocks(refs: DataFrame, chosen: DataFrame, blocks: DataFrame, by: str = "path") -> DataFrame:
    """Blocks that an extraction must read, and up to which fragment each."""
    own = to_blocks(refs.join(chosen.select(by), by, "left_semi"), blocks)
    return own.groupBy("block_id", "start").agg((F.max("frag_id") - F.first("start") + 1).alias("frags_to_read"), F.count_distinct(by).alias("files"))
