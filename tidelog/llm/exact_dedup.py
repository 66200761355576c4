"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Equal blocks get one integer name, from their place in
sorted order; then adjacent pairs of names are named in the same way, round after round, until each document
has one name. Two documents have the same number of blocks and the same last name if and only if their texts
are equal: names stand for contents, not for hashes, so nothing can collide.

Cost: the texts are shuffled once, and of equal blocks within one Arrow batch only one goes; later rounds shuffle
integers of documents that still have over one name. A block that a third of all rows share thus reaches its
sorter once for each batch, not once for each row. The way back from block to document goes by the batch's own
key of the block, so no key has more rows than a batch.

Defined results: null text counts as empty; the empty text is one empty block; only A-Z are lower-cased; rows that
repeat a doc_id are rows of their own (each returned; all with the doc_id that stays are kept); an empty table gives
an empty result; columns besides doc_id and text are ignored; a null doc_id is below all others.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import discard, keep_rows, table, written

BLOCK_BYTES = 4096
#: Sorted runs that names are dealt from; a name is its run's number and its place in the run.
RUNS = 1 << 16
RUN_SHIFT = 40

_CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("text_sha256", pa.string()), ("pos", pa.int64()), ("n_blocks", pa.int64()), ("key", pa.int64()), ("block", pa.binary())])
_CUT_SQL = "row long, doc_id long, tag long, text_sha256 string, pos long, n_blocks long, key long, block binary"


def _cut(block_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        # Row and key numbers hold the task's number above 36 bits: unique, and equal when a lost task runs again.
        base = TaskContext.get().partitionId() << 36
        row = key = base
        for batch in batches:
            out = {f.name: [] for f in _CUT}
            known: dict[bytes, int] = {}
            size = 0
            for doc_id, text, tag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower()
                sha, n = hashlib.sha256(data).hexdigest(), max(1, -(-len(data) // block_bytes))
                for pos in range(n):
                    block = data[pos * block_bytes : (pos + 1) * block_bytes]
                    own = known.get(block)
                    if new := own is None:
                        own = known[block] = key
                        key += 1
                        size += len(block)
                    for name, value in zip(out, (row, doc_id, tag, sha if pos == 0 else None, pos, n, own, block if new else None), strict=True):
                        out[name].append(value)
                    if size >= 16 << 20:
                        yield pa.RecordBatch.from_pydict(out, schema=_CUT)
                        out, known, size = {f.name: [] for f in _CUT}, {}, 0
                row += 1
            yield pa.RecordBatch.from_pydict(out, schema=_CUT)

    return run


def _named(distinct: DataFrame, by: list[str], run_of) -> DataFrame:
    """Adds name: equal rows in `by` get one name, from their rank in the sorted run that their content's hash picks."""
    run = F.pmod(run_of, F.lit(RUNS))
    rank = F.dense_rank().over(Window.partitionBy("run").orderBy(*by))
    return distinct.withColumn("run", run).withColumn("name", F.shiftleft(F.col("run").cast("long"), RUN_SHIFT) + rank)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row, doc_id, tag (hash of the text as it is), text_sha256, n_blocks, name: texts are equal if and only if (n_blocks, name) are."""
    spark = docs.sparkSession
    cut = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("tag")).mapInArrow(_cut(block_bytes), _CUT_SQL), "blocks")
    places = cut.select("row", "pos", "n_blocks", "key")
    names = _named(cut.filter("block IS NOT NULL").select("key", "block"), ["block"], F.xxhash64("block")).select("key", "name")
    heads = cut.filter("pos = 0").select("row", "doc_id", "tag", "text_sha256", "n_blocks")
    level = written(places.join(names, "key").select("row", "pos", "n_blocks", "name"), "names")
    heads = written(heads, "heads")
    discard(cut)  # the texts' blocks, far larger than all that follows
    done, width = level.filter("n_blocks = 1").select("row", "name"), level.agg(F.max("n_blocks")).first()[0] or 1
    left = level.filter("n_blocks > 1").withColumn("n", F.col("n_blocks"))
    while width > 1:
        # One row for each pair: the left name at an even place, the right one (0 past the end) after it.
        pairs = left.groupBy("row", "n", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")
        )
        # Numbered from the distinct pairs, so a pair that many documents hold is sorted once.
        ranks = _named(pairs.select("a", "b").distinct(), ["a", "b"], F.xxhash64("a", "b")).select("a", "b", "name")
        step = written(pairs.join(ranks, ["a", "b"]).select("row", "pos", F.expr("(n + 1) div 2").alias("n"), "name"), "names")
        done = done.unionByName(step.filter("n = 1").select("row", "name"))
        left, width = step.filter("n > 1"), (width + 1) // 2
    return heads.join(done, "row")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, keep_id (largest doc_id of the rows with an equal text), group_size, kept, text_sha256."""
    rows = written(identities(docs, block_bytes, text, doc_id), "identities")
    # Both sides of the join below come from tables, so that adaptive execution may split a large group's rows.
    groups = written(rows.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = rows.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal texts: of its largest doc_id; of that one's rows, an arbitrary but repeatable
    spelling, and one of the rows that repeat it. A doc_id's other texts stay or go with their own groups."""
    rows = written(identities(docs, block_bytes, text, doc_id), "identities")
    stays = written(rows.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "tag")).alias("stay")), "groups")
    kept = F.expr("doc_id <=> stay.doc_id AND tag = stay.tag")
    verdicts = written(rows.join(stays, ["n_blocks", "name"]).select("doc_id", "tag", kept.alias("kept")), "verdicts")
    discard(rows)
    discard(stays)
    return keep_rows(docs, verdicts, F.xxhash64(text), True, doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


#: translate() lower-cases A-Z only, as the operator does.
NORMAL_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH t AS (SELECT doc_id, {NORMAL_SQL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
