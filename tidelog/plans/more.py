"""More queries of the catalogue engine with their oracles; QUERIES and ORACLES are those of the registry and these."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import scalar as fn
from tidelog.operators import compare, fragments, journal, report, selection, verify
from tidelog.plans import adapters as a
from tidelog.plans.registry import _ASOF, ORACLES, QUERIES, _with, query

__all__ = ["ORACLES", "QUERIES"]

# --- selection and projection --------------------------------------------------------------------------------------


@query(
    "select_renamed",
    _with(a.TREE)
    + r"SELECT path FROM tree WHERE regexp_matches(path, '(?is)^src2/en(/.*)?\z') AND NOT regexp_matches(path, '(?is)^.*9\.txt(/.*)?\z')",
)
def _select_renamed(s, d):
    return a.tree(s, d).filter(selection.selected_renamed(F.col("path"), ["src2/en"], ["other"], (), ["*9.txt"])).select("path")


@query("until_words", "SELECT * FROM (VALUES ('2024/1/5', '20240105235959'), ('2024-01-05 9:30', '20240105093059'), ('202401', '202401'), ('2024 1', '202401'), "
       "('1234567', '1234567'), ('20240231', '20240229235959'), ('-3', '-3'), ('2024 12 31 7', '20241231075959')) AS t(words, means)")
def _until_words(s, d):
    words = ["2024/1/5", "2024-01-05 9:30", "202401", "2024 1", "1234567", "20240231", "-3", "2024 12 31 7"]
    means = lambda x: str(x) if isinstance(x, int) else x.strftime("%Y%m%d%H%M%S")
    return s.createDataFrame([(w, means(selection.parse_until(*w.split()))) for w in words], "words string, means string")


@query("glob_line_feed", _with(a.TREE) + "SELECT doc_id FROM tree WHERE doc_id % 3 > 0 AND lower(path) LIKE 'src1/%.txt'")
def _glob_line_feed(s, d):
    """A path that ends in a line feed is another path: neither it nor what merely starts alike matches."""
    t = a.tree(s, d).withColumn("path", F.when(F.col("doc_id") % 3 == 0, F.concat("path", F.lit("\n"))).otherwise(F.col("path")))
    return t.filter(selection.selected(F.col("path"), ["SRC1/*.txt"])).select("doc_id")


@query("project_listing", _with(a.TREE) + "SELECT path, CAST(0 AS BIGINT) AS attr, TIMESTAMP '2024-02-03 04:05:06' AS mtime FROM tree")
def _project_listing(s, d):
    return fn.touched(fn.no_attributes(a.tree(s, d).select("path", F.col("size").alias("attr"))), "2024-02-03 04:05:06")


@query("path_forms", _with(a.TREE).rstrip() + """, p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'C:\\dir\\' || doc_id WHEN 1 THEN 'a/COM1.txt' WHEN 2 THEN 'x/what?*.' || doc_id
       WHEN 3 THEN 'aux' ELSE path END AS path FROM tree)
    SELECT doc_id, regexp_replace(replace(path, '\\', '/'), '^([A-Za-z]):', '\\1') AS normal,
           regexp_replace(path, '[<>:"|?*\\x00-\\x1F]', '_', 'g') AS safe,
           CASE doc_id % 5 WHEN 1 THEN 'a/_COM1.txt' WHEN 3 THEN '_aux' ELSE path END AS unreserved, replace(path, '/', '_') AS flat FROM p""")
def _path_forms(s, d):
    n, number = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    path = F.when(n == 0, F.concat(F.lit("C:\\dir\\"), number)).when(n == 1, "a/COM1.txt").when(n == 2, F.concat(F.lit("x/what?*."), number)).when(n == 3, "aux").otherwise(F.col("path"))
    t = a.tree(s, d).withColumn("path", path)
    p = F.col("path")
    return t.select("doc_id", fn.normal_path(p).alias("normal"), fn.safe_name(p).alias("safe"), fn.unreserved(p).alias("unreserved"), fn.flat(p).alias("flat"))


@query("case_collisions", _with(a.TREE) + ", p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '/' || lang AS path FROM tree JOIN documents USING (doc_id)) "
       "SELECT lower(path) AS folded, count(DISTINCT path) AS paths, min(path) AS first FROM p GROUP BY lower(path) HAVING count(DISTINCT path) > 1")
def _case_collisions(s, d):
    t = a.table(s, d, "documents")
    return fn.case_collisions(t.select(F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("/"), "lang").alias("path")))


# --- fragments, blocks, parts --------------------------------------------------------------------------------------

_CAPPED = """n AS (SELECT *, row_number() OVER w AS i, CASE WHEN lag(frag_id) OVER w + 1 = frag_id AND lag(block_id) OVER w = block_id THEN 0 ELSE 1 END AS new
    FROM placed WINDOW w AS (PARTITION BY path ORDER BY {order})),
  r AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY i) AS run FROM n),
  o AS (SELECT path, run, block_id, frag_id, usize, row_number() OVER (PARTITION BY path, run ORDER BY i) AS k FROM r),
  g AS (SELECT path, run, block_id, frag_id, usize, k, usize AS total, 0 AS cut FROM o WHERE k = 1
        UNION ALL SELECT o.path, o.run, o.block_id, o.frag_id, o.usize, o.k, CASE WHEN g.total + o.usize > 40 THEN o.usize ELSE g.total + o.usize END,
        CASE WHEN g.total + o.usize > 40 THEN g.cut + 1 ELSE g.cut END FROM g JOIN o ON o.path = g.path AND o.run = g.run AND o.k = g.k + 1)
  SELECT path, CAST(run AS BIGINT) AS run, min(block_id) AS block_id, min(frag_id) AS first_frag, count(*) AS frags, CAST(sum(usize) AS BIGINT) AS bytes
  FROM g GROUP BY path, run, cut"""


@query("coalesced_runs_capped", "WITH RECURSIVE " + ", ".join([a.REFS, a.BLOCKS, _ASOF, _CAPPED.format(order=a.ORDER_SQL)]))
def _capped(s, d):
    return fragments.runs(fragments.to_blocks(a.refs(s, d), a.blocks(s, d)), a.REF_ORDER, most=40)


_BAD = """bad AS (SELECT block_id, CASE block_id % 9 WHEN 1 THEN 0 WHEN 2 THEN start + 100000000 WHEN 4 THEN start - 64 ELSE start END AS start,
    CASE WHEN block_id % 9 = 6 THEN -5 ELSE 100 END AS bsize, CASE WHEN block_id % 9 = 8 THEN 0 ELSE block_id * 100 END AS "offset" FROM blocks),
  seen AS (SELECT *, lag(start) OVER w AS s, lag("offset" + bsize) OVER w AS p FROM bad WINDOW w AS (ORDER BY block_id))"""


@query("block_structure", _with(a.BLOCKS, _BAD) + """SELECT * FROM (SELECT block_id, CASE WHEN bsize < 0 THEN 'negative block size' WHEN start < 1 THEN 'block starts at fragment 0'
    WHEN start > (SELECT count(*) FROM part) THEN 'block start too high' WHEN start < s THEN 'unordered frags' WHEN start = s THEN 'empty block'
    WHEN "offset" < p THEN 'unordered blocks' END AS fault FROM seen) WHERE fault IS NOT NULL""")
def _block_structure(s, d):
    n, start = F.col("block_id") % 9, F.col("start")
    blocks = a.blocks(s, d).withColumns({
        "start": F.when(n == 1, 0).when(n == 2, start + 100_000_000).when(n == 4, start - 64).otherwise(start),
        "bsize": F.when(n == 6, -5).otherwise(100),
        "offset": F.when(n == 8, 0).otherwise(F.col("block_id") * 100),
    })
    return verify.block_check(blocks, a.fragments(s, d).count())


@query("block_memory", _with(a.FRAGMENTS, a.BLOCKS, "b AS (SELECT block_id, 8 + sum(usize + 4) AS usize FROM fragments f ASOF JOIN blocks b ON f.frag_id >= b.start GROUP BY block_id)")
       + "SELECT CAST(max(usize) AS BIGINT) AS most, CAST(sum(usize) AS BIGINT) AS total, count(*) AS blocks FROM b")
def _block_memory(s, d):
    return report.block_memory(fragments.block_sizes(fragments.to_blocks(a.fragments(s, d), a.blocks(s, d))))


@query("packed_sizes", _with(a.LOG) + ", v AS (SELECT ver, count(*) AS csize FROM log GROUP BY ver) SELECT (SELECT count(*) FROM log) AS dhsize, CAST((SELECT sum(csize) FROM v) AS BIGINT) AS dcsize, true AS ok")
def _packed_sizes(s, d):
    log = a.log(s, d)
    return verify.packed_sizes(log.select(F.lit(1).cast("long").alias("bsize")), log.groupBy("ver").agg(F.count(F.lit(1)).alias("csize")))


@query("index_check", _with(a.FRAGMENTS) + "SELECT frag_id AS block_id, frag_id % 10 <> 0 AS size_ok, frag_id % 7 <> 0 AS sha1_ok FROM fragments")
def _index_check(s, d):
    f = a.fragments(s, d)
    size = F.octet_length("content") + F.when(F.col("frag_id") % 10 == 0, 1).otherwise(0)
    return verify.index_check(f.select(F.col("frag_id").alias("block_id"), "content", size.alias("usize"), F.when(F.col("frag_id") % 7 == 0, "").otherwise(F.col("sha1")).alias("sha1")))


@query("seek_parts", _with(a.TREE) + """, p AS (SELECT doc_id AS part, size, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM tree)
    SELECT part, CAST(100000 - begun AS BIGINT) AS place FROM p WHERE begun <= 100000 AND 100000 < begun + size""")
def _seek_parts(s, d):
    from tidelog.sources import files

    parts = report.running_total(a.tree(s, d).select(F.col("doc_id").alias("part"), "size"), "part", "size", "offset")
    return files.seek(parts, 100_000)


@query("sparse_fragments", _with(a.CHUNKS) + """, z AS (SELECT path, part, CASE WHEN part % 2 = 1 THEN '' ELSE chunk END AS chunk, max(part) OVER (PARTITION BY path) AS top FROM chunks)
    SELECT path, part FROM z WHERE chunk <> '' OR part = top""")
def _sparse_fragments(s, d):
    from tidelog.sources import files

    chunks = a.chunks(s, d).withColumn("chunk", F.when(F.col("part") % 2 == 1, F.unhex(F.lit("0000"))).otherwise(F.col("chunk").cast("binary")))
    return files.non_zero(chunks, "chunk").select("path", "part")


# --- verification and comparison -----------------------------------------------------------------------------------


@query("three_way_check", _with(a.PAIR, "c AS (SELECT path, CAST(doc_id AS VARCHAR) || sha1 AS sha1 FROM tree WHERE doc_id % 3 = 0 UNION ALL SELECT path, sha1 FROM tree WHERE doc_id % 3 = 1)") + """
    SELECT coalesce(m.path, s.path, c.path) AS path, m.sha1 = s.sha1 AS archive_ok, m.sha1 = c.sha1 AS file_ok
    FROM master m FULL JOIN slave s ON m.path = s.path FULL JOIN c ON c.path = coalesce(m.path, s.path)""")
def _three_way(s, d):
    t = a.tree(s, d)
    read = t.filter("doc_id % 3 <> 2").withColumn("sha1", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id").cast("string"), "sha1")).otherwise(F.col("sha1")))
    return verify.three_way(a.master(s, d), a.slave(s, d), read)


@query("quick_test", _with(a.TREE) + "SELECT path, CASE WHEN doc_id % 4 > 0 THEN doc_id % 3 > 0 END AS ok FROM tree")
def _quick_test(s, d):
    t = a.tree(s, d).withColumn("mtime", F.expr("date_add(DATE'2024-01-01', CAST(doc_id % 300 AS INT))"))
    files = t.filter("doc_id % 4 > 0").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0))
    return verify.quick_test(t, files)


_HASHES = """fh AS (SELECT path, CAST(sum(length(chunk)) AS BIGINT) AS size, list(sha1(chunk) ORDER BY part) AS hashes FROM chunks GROUP BY path),
  gh AS (SELECT path, CAST(sum(length(chunk)) AS BIGINT) AS size, list(sha1(chunk) ORDER BY part DESC) AS hashes FROM chunks WHERE CAST(path AS BIGINT) % 5 > 0 GROUP BY path)"""


@query("compare_fragment_hashes", _with(a.CHUNKS, _HASHES) + "SELECT coalesce(f.path, g.path) AS path, coalesce(f.size = g.size AND f.hashes = g.hashes, false) AS equal FROM fh f FULL JOIN gh g ON f.path = g.path")
def _compare_fragment_hashes(s, d):
    def lists(chunks, order):
        one = F.struct(order.alias("o"), F.sha1(F.col("chunk").cast("binary")).alias("h"))
        parts = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["h"])
        return chunks.groupBy("path").agg(F.sum(F.length("chunk")).alias("size"), parts.alias("hashes"))

    chunks = a.chunks(s, d)
    return compare.compare_fragments(lists(chunks, F.col("part")), lists(chunks.filter("CAST(path AS BIGINT) % 5 > 0"), -F.col("part")))


@query("transfer_plan", _with(a.PAIR) + """SELECT m.path, CASE WHEN s.path IS NULL THEN 'send' WHEN m.size = s.size AND m.sha1 = s.sha1 THEN 'keep'
    WHEN s.size < m.size THEN 'append' ELSE 'conflict' END AS action FROM master m LEFT JOIN slave s ON m.path = s.path""")
def _transfer_plan(s, d):
    return compare.transfer_plan(a.master(s, d), a.slave(s, d), "sha1")


# --- functions -----------------------------------------------------------------------------------------------------


@query("quick_hashes", _with(a.TREE) + """SELECT doc_id, sha1(concat_ws('|', substring(content, 1, 4096), substring(content, greatest(1, length(content) // 2), 4096),
    right(content, 4096), length(content))) AS quick FROM tree""")
def _quick_hashes(s, d):
    return a.tree(s, d).select("doc_id", fn.quick_hash(F.col("content")).alias("quick"))


@query("date_parts", "SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS number, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, "
       "CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute, CAST(second(ts) AS BIGINT) AS second FROM events")
def _date_parts(s, d):
    e = a.table(s, d, "events").select("event_id", fn.date_int(F.col("ts")).alias("number"))
    return e.select("event_id", "number", fn.date_fields(F.col("number")).alias("f")).select("event_id", "number", *(F.col(f"f.{n}").cast("long").alias(n) for n in ("year", "month", "day", "hour", "minute", "second")))


@query("date_names", "SELECT event_id, 'w' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') || ' ' || dayname(ts) || ' ' || CAST(floor(epoch(ts)) AS BIGINT) AS name FROM events")
def _date_names(s, d):
    return a.table(s, d, "events").select("event_id", fn.fill_date(F.lit("w%week %weekday %timestamp"), F.col("ts")).alias("name"))


@query("elapsed_times", "SELECT event_id, lpad(CAST(event_id * 7 // 3600 AS VARCHAR), greatest(2, length(CAST(event_id * 7 // 3600 AS VARCHAR)))::INT, '0') || ':' || "
       "lpad(CAST(event_id * 7 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id * 7 % 60 AS VARCHAR), 2, '0') AS took FROM events")
def _elapsed(s, d):
    return a.table(s, d, "events").select("event_id", fn.elapsed(F.col("event_id") * 7).alias("took"))


@query("utf16_round_trip", "SELECT doc_id, text AS back, CAST(2 * length(text) AS BIGINT) AS bytes FROM documents")
def _utf16(s, d):
    t = a.table(s, d, "documents").withColumn("wide", fn.utf16(F.col("text")))
    return t.select("doc_id", fn.from_utf16(F.col("wide")).alias("back"), F.octet_length("wide").cast("long").alias("bytes"))


@query("elias_gamma", "SELECT l_orderkey + 1 AS n, repeat('0', length(bin(l_orderkey + 1)) - 1) || bin(l_orderkey + 1) AS code, l_orderkey + 1 AS back FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def _gamma(s, d):
    t = a.table(s, d, "lineitem").select((F.col("l_orderkey") + 1).alias("n")).distinct().withColumn("code", fn.elias_gamma(F.col("n")))
    return t.withColumn("back", fn.from_elias_gamma(F.col("code")))


@query("all_zero", "SELECT p_partkey, p_size % 4 = 0 AS zero FROM part")
def _all_zero(s, d):
    return a.table(s, d, "part").select("p_partkey", fn.all_zero(F.when(F.col("p_size") % 4 == 0, "000000").when(F.col("p_size") % 4 == 1, "").otherwise("0010")).alias("zero"))


@query("little_endian_numbers", "SELECT p_partkey, CAST(p_partkey AS DECIMAL(20, 0)) AS back FROM part")
def _little(s, d):
    t = a.table(s, d, "part").withColumn("hex", fn.to_little_endian(F.col("p_partkey"), 8))
    return t.select("p_partkey", fn.little_endian(F.col("hex")).alias("back"))


# --- reports -------------------------------------------------------------------------------------------------------


@query("errors_by_code", "SELECT event_type AS code, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY event_type")
def _errors(s, d):
    return report.errors_by_code(a.table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("code")), "code")


@query("size_percentiles", _with(a.TREE) + "SELECT split_part(path, '/', 1) AS folder, round(quantile_cont(size, 0.25), 6) AS p25, round(quantile_cont(size, 0.5), 6) AS p50, round(quantile_cont(size, 0.9), 6) AS p90 FROM tree GROUP BY ALL")
def _percentiles(s, d):
    t = a.tree(s, d).withColumn("folder", F.substring_index("path", "/", 1))
    return report.spread(t, "size", "folder").select("folder", *(F.round(c, 6).alias(c) for c in ("p25", "p50", "p90")))


@query("grouping_sets", "SELECT source, lang, grouping(source) AS no_source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def _sets(s, d):
    t = a.table(s, d, "documents")
    sets = t.groupingSets([[F.col("source"), F.col("lang")], [F.col("source")], []], F.col("source"), F.col("lang"))
    return sets.agg(F.grouping("source").cast("long").alias("no_source"), F.count(F.lit(1)).alias("n"))


@query("rank_windows", _with(a.TREE) + """SELECT doc_id, dense_rank() OVER w AS dense, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS share, nth_value(doc_id, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
    count(*) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY size RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near
    FROM tree WINDOW w AS (PARTITION BY split_part(path, '/', 1) ORDER BY size, doc_id)""")
def _ranks(s, d):
    own = Window.partitionBy(F.substring_index("path", "/", 1))
    w = own.orderBy("size", "doc_id")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return a.tree(s, d).select(
        "doc_id",
        F.dense_rank().over(w).cast("long").alias("dense"),
        F.ntile(4).over(w).cast("long").alias("quarter"),
        F.round(F.percent_rank().over(w), 9).alias("share"),
        F.nth_value("doc_id", 2).over(every).alias("second"),
        F.count(F.lit(1)).over(own.orderBy("size").rangeBetween(-100, 0)).alias("near"),
    )


@query("csv_with_ends", _with(a.TREE) + "SELECT line, place FROM (SELECT path || chr(9) || size AS line, 1 AS place FROM tree UNION ALL SELECT 'path and size', 0 UNION ALL SELECT 'end', 2)")
def _csv_ends(s, d):
    return report.csv_lines(a.tree(s, d), ["path", "size"], "\\t", "path and size", "end")


@query("sliding_windows", """SELECT start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day']) AS start FROM events) GROUP BY start""")
def _sliding(s, d):
    return a.table(s, d, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("session_windows", """SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session""")
def _sessions(s, d):
    w = F.session_window("ts", "12 hours").alias("w")
    return a.table(s, d, "events").groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("latest_by_journal_versions", _with(a.LOG, "cut AS (SELECT * FROM log WHERE ver > (SELECT max(ver) FROM log) - 3)", a.LATEST) + "SELECT path, ver, deleted FROM last")
def _latest_tail(s, d):
    return journal.latest(journal.version_range(a.log(s, d), tail=3)).select("path", "ver", "deleted")
