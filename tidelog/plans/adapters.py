"""The driver's tables seen as catalogue entities, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), "user_id", F.lit("/k"), F.get_json_object("props", "$.k")).alias("path"),
        (F.col("event_type") == "error").alias("deleted"),
        F.col("value").alias("size"),
        F.col("ts").alias("mtime"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("ver"),
    )


def tree(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"), F.sha1(F.col("text").cast("binary")).alias("sha1"))


def master(spark, sf) -> DataFrame:
    return tree(spark, sf).filter("doc_id % 7 <> 0")


def slave(spark, sf) -> DataFrame:
    t = tree(spark, sf).filter("doc_id % 5 <> 0")
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return t.withColumn("content", changed).withColumns({"size": F.octet_length("content").cast("long"), "sha1": F.sha1(F.col("content").cast("binary"))})


def refs(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") + 1).alias("frag_id"), F.col("l_quantity").cast("long").alias("usize"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


#: (l_orderkey, l_linenumber) is not unique, so a file's order of fragments needs the other columns.
REF_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "usize"]


def files(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"))


def fragments(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select((F.col("p_partkey") + 1).alias("frag_id"), F.concat("p_name", "p_brand", "p_type").alias("content"), F.sha1(F.concat("p_name", "p_brand", "p_type").cast("binary")).alias("sha1"), F.col("p_size").cast("long").alias("usize"))


def blocks(spark, sf) -> DataFrame:
    """A block for each 64 fragments of part."""
    number = F.expr("p_partkey div 64").alias("block_id")
    found = table(spark, sf, "part").groupBy(number).agg(F.count(F.lit(1)).alias("frags"))
    return found.select("block_id", (1 + 64 * F.col("block_id")).alias("start"), "frags")


def chunks(spark, sf, size: int = 512) -> DataFrame:
    from tidelog.operators.fragments import fixed_chunks

    return fixed_chunks(tree(spark, sf).withColumn("path", F.col("doc_id").cast("string")), size)


LOG = """log AS (SELECT event_id AS seq, 'u' || user_id || '/k' || json_extract_string(props, '$.k') AS path, event_type = 'error' AS deleted,
  value AS size, ts AS mtime, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS ver FROM events)"""
TREE = """tree AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha1(text) AS sha1 FROM documents)"""
PAIR = f"""{TREE}, master AS (SELECT * FROM tree WHERE doc_id % 7 <> 0),
  slave0 AS (SELECT doc_id, path, CASE WHEN doc_id % 11 = 0 THEN content || '!' ELSE content END AS content FROM tree WHERE doc_id % 5 <> 0),
  slave AS (SELECT doc_id, path, content, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha1(content) AS sha1 FROM slave0)"""
REFS = """refs AS (SELECT l_orderkey AS path, l_partkey + 1 AS frag_id, CAST(l_quantity AS BIGINT) AS usize, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"""
ORDER_SQL = ", ".join(REF_ORDER)
FRAGMENTS = "fragments AS (SELECT p_partkey + 1 AS frag_id, p_name || p_brand || p_type AS content, sha1(p_name || p_brand || p_type) AS sha1, CAST(p_size AS BIGINT) AS usize FROM part)"
BLOCKS = "blocks AS (SELECT p_partkey // 64 AS block_id, 1 + 64 * (p_partkey // 64) AS start, count(*) AS frags FROM part GROUP BY ALL)"
CHUNKS = "chunks AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i AS BIGINT) AS part, substring(text, CAST(i * 512 + 1 AS BIGINT), 512) AS chunk FROM documents, LATERAL (SELECT unnest(range(CAST(ceil(length(text) / 512.0) AS BIGINT))) AS i))"
LATEST = "last AS (SELECT path, max_by(seq, seq) AS seq, max_by(deleted, seq) AS deleted, max_by(size, seq) AS size, max_by(mtime, seq) AS mtime, max_by(ver, seq) AS ver FROM cut GROUP BY path)"
