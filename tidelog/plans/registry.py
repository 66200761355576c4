"""All queries of the catalogue engine and, where SQL can say the same, their oracles. Each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import scalar as fn
from tidelog.operators import chunking, compare, fragments, journal, report, selection, verify
from tidelog.plans import adapters as a

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _live(df):
    return df.select("path", "ver", F.round("size", 2).alias("size"))


_LIVE = "SELECT path, ver, round(size, 2) AS size FROM last WHERE NOT deleted AND path <> ''"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# --- journal -------------------------------------------------------------------------------------------------------

query("snapshot_latest", _with(a.LOG, "cut AS (SELECT * FROM log)", a.LATEST) + _LIVE)(lambda s, d: _live(journal.snapshot(a.log(s, d))))
query("snapshot_until_version", _with(a.LOG, "cut AS (SELECT * FROM log WHERE ver <= 15)", a.LATEST) + _LIVE)(lambda s, d: _live(journal.snapshot(journal.until_version(a.log(s, d), 15))))
query("snapshot_minus_k", _with(a.LOG, "cut AS (SELECT * FROM log WHERE ver <= (SELECT max(ver) FROM log) - 5)", a.LATEST) + _LIVE)(lambda s, d: _live(journal.snapshot(journal.until_version(a.log(s, d), -5))))


@query("snapshot_until_date", _with(a.LOG, "v AS (SELECT ver, min(mtime) AS date FROM log GROUP BY ver)", "cut AS (SELECT * FROM log WHERE ver < coalesce((SELECT min(ver) FROM v WHERE date > TIMESTAMP '2024-01-10 23:59:59'), 1000000))", a.LATEST) + _LIVE)
def _until_date(s, d):
    log = a.log(s, d)
    return _live(journal.snapshot(journal.until_date(log, journal.version_table(log), selection.parse_until("20240110"))))


@query("snapshot_complete_only", _with(a.LOG, "v AS (SELECT ver, CASE WHEN ver = 28 THEN -1 ELSE sum(size) END AS csize FROM log GROUP BY ver)", "cut AS (SELECT * FROM log WHERE ver < (SELECT min(ver) FROM v WHERE csize < 0))", a.LATEST) + _LIVE)
def _complete(s, d):
    log = a.log(s, d)
    versions = journal.version_table(log).withColumn("csize", F.when(F.col("ver") == 28, -1.0).otherwise(F.col("csize")))
    return _live(journal.snapshot(journal.complete(log, versions)))


query("tombstones_only", _with(a.LOG, "cut AS (SELECT * FROM log)", a.LATEST) + "SELECT path, ver FROM last WHERE deleted")(lambda s, d: journal.latest(a.log(s, d)).filter("deleted").select("path", "ver"))
query("history_all_versions", _with(a.LOG) + "SELECT seq, lpad(CAST(ver AS VARCHAR), CAST(greatest(4, length(CAST(ver AS VARCHAR))) AS INTEGER), '0') || '/' || path AS path, deleted FROM log")(lambda s, d: journal.history(a.log(s, d)).select("seq", "path", "deleted"))
query("file_history", _with(a.LOG) + "SELECT path, ver, seq, round(size, 2) AS size FROM log WHERE path LIKE 'u1/%'")(lambda s, d: a.log(s, d).filter(F.col("path").startswith("u1/")).select("path", "ver", "seq", F.round("size", 2).alias("size")).orderBy("path", "seq"))
_VERSIONS = "versions AS (SELECT ver, min(mtime) AS date, max(mtime) AS lastdate, count(*) FILTER (NOT deleted) AS updates, count(*) FILTER (deleted) AS deletes, sum(size) AS csize FROM log GROUP BY ver)"
query("version_table", _with(a.LOG, _VERSIONS) + "SELECT ver, CAST(strftime(date, '%Y%m%d%H%M%S') AS BIGINT) AS date, CAST(strftime(lastdate, '%Y%m%d%H%M%S') AS BIGINT) AS lastdate, updates, deletes, round(csize, 2) AS csize FROM versions")(
    lambda s, d: journal.version_table(a.log(s, d)).select("ver", fn.date_int(F.col("date")).alias("date"), fn.date_int(F.col("lastdate")).alias("lastdate"), "updates", "deletes", F.round("csize", 2).alias("csize"))
)
query("version_info", _with(a.LOG, _VERSIONS) + "SELECT ver, updates, deletes, round(csize, 2) AS csize FROM versions")(lambda s, d: report.version_info(journal.version_table(a.log(s, d))).withColumn("csize", F.round("csize", 2)))
query("version_info_rollup", _with(a.LOG, _VERSIONS) + "SELECT ver, CAST(sum(updates) AS BIGINT) AS updates, CAST(sum(deletes) AS BIGINT) AS deletes, round(sum(csize), 2) AS csize FROM versions GROUP BY ROLLUP (ver)")(lambda s, d: report.version_info(journal.version_table(a.log(s, d)), total=True).withColumn("csize", F.round("csize", 2)))


@query("version_range", _with(a.LOG) + "SELECT ver, count(*) AS entries FROM log WHERE ver BETWEEN 5 AND 9 GROUP BY ver")
def _range(s, d):
    first, last, tail = selection.parse_range("5:9")
    return journal.version_range(a.log(s, d), first, last, tail).groupBy("ver").agg(F.count(F.lit(1)).alias("entries"))


query("version_last_k", _with(a.LOG) + "SELECT ver, count(*) AS entries FROM log WHERE ver > (SELECT max(ver) FROM log) - 3 GROUP BY ver")(lambda s, d: journal.version_range(a.log(s, d), *selection.parse_range("::3")).groupBy("ver").agg(F.count(F.lit(1)).alias("entries")))
query("info_last_lines", _with(a.LOG, _VERSIONS) + "SELECT ver, updates FROM versions WHERE ver IN (SELECT ver FROM versions ORDER BY ver DESC LIMIT 4)")(lambda s, d: report.last_versions(journal.version_table(a.log(s, d)), 4).select("ver", "updates"))
query("crop_by_version", _with(a.LOG) + "SELECT seq, ver FROM log WHERE ver <= 12")(lambda s, d: journal.until_version(a.log(s, d), 12).select("seq", "ver"))
_CENTS = "v AS (SELECT ver, CAST(round(sum(size)) AS BIGINT) AS csize FROM log GROUP BY ver)"


def _cents(s, d):
    return a.log(s, d).groupBy("ver").agg(F.round(F.sum("size")).cast("long").alias("csize"))


query("crop_by_bytes", _with(a.LOG, _CENTS) + "SELECT ver, csize, total FROM (SELECT ver, csize, CAST(sum(csize) OVER (ORDER BY ver) AS BIGINT) AS total FROM v) WHERE total <= 150000")(lambda s, d: journal.crop_bytes(_cents(s, d), 150000))
query("version_numbers", _with(a.LOG, "v AS (SELECT min(seq) AS place FROM log GROUP BY mtime::DATE)") + "SELECT place, row_number() OVER (ORDER BY place) AS ver FROM v")(lambda s, d: journal.numbered(a.log(s, d).groupBy(F.to_date("mtime")).agg(F.min("seq").alias("place")), "place").select("place", F.col("ver").cast("long").alias("ver")))
query("first_fragments", _with(a.LOG, "v AS (SELECT ver, count(*) AS fragments FROM log GROUP BY ver)") + "SELECT ver, CAST(coalesce(sum(fragments) OVER (ORDER BY ver ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_fragment FROM v")(
    lambda s, d: journal.first_fragments(a.log(s, d).groupBy("ver").agg(F.count(F.lit(1)).alias("fragments"))).select("ver", "first_fragment")
)
query("versions_diff", _with(a.LOG, "o AS (SELECT *, lag(deleted) OVER w AS gone, lag(size) OVER w AS old FROM log WINDOW w AS (PARTITION BY path ORDER BY seq))") + "SELECT seq, path, CASE WHEN deleted THEN 'deleted' WHEN gone IS NULL OR gone THEN 'added' WHEN size IS NOT DISTINCT FROM old THEN 'same' ELSE 'modified' END AS change FROM o")(
    lambda s, d: journal.version_changes(a.log(s, d)).select("seq", "path", "change")
)
query("change_set", _with(a.PAIR) + "SELECT coalesce(m.path, s.path) AS path, CASE WHEN m.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM master m FULL JOIN slave s ON m.path = s.path WHERE m.path IS NULL OR s.path IS NULL OR m.size <> s.size OR m.sha1 <> s.sha1")(
    lambda s, d: journal.change_set(a.master(s, d), a.slave(s, d), ["size", "sha1"])
)
query("change_set_nodelete", _with(a.PAIR) + "SELECT s.path AS path, CASE WHEN m.path IS NULL THEN 'added' ELSE 'changed' END AS status FROM slave s LEFT JOIN master m ON m.path = s.path WHERE m.path IS NULL OR m.size <> s.size OR m.sha1 <> s.sha1 OR ends_with(s.path, '3.txt')")(
    lambda s, d: journal.change_set(a.master(s, d), a.slave(s, d), ["size", "sha1"], always=F.col("b.path").endswith("3.txt"), tombstones=False)
)
query("conversation_last_turn", "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations GROUP BY conv_id")(lambda s, d: journal.latest(a.table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn"))

# --- selection -----------------------------------------------------------------------------------------------------

_SELECT = "regexp_matches(path, '(?is)^src1.*/en/.*\\.txt(/.*)?$') AND regexp_matches(path, '(?is)^.*(/.*)?$') AND NOT regexp_matches(path, '(?is)^.*7\\.txt(/.*)?$')"
query("select_only_not", _with(a.TREE) + f"SELECT path, size FROM tree WHERE {_SELECT}")(lambda s, d: selection.select_paths(a.tree(s, d), ["SRC1*/en/*.txt"], ["*"], ["*7.TXT"]).select("path", "size"))
query("glob_match", _with(a.TREE) + "SELECT path, regexp_matches(path, '(?is)^src?(/.*)?$') AS folder, regexp_matches(path, '(?is)^src1./de/.*$') AS below, starts_with(path, 'src2/') AS exact FROM tree".replace("src?", "src."))(
    lambda s, d: a.tree(s, d).select("path", selection.matches(F.col("path"), "SRC?").alias("folder"), selection.matches(F.col("path"), "src1?/de/").alias("below"), selection.matches(F.col("path"), "src2").alias("exact"))
)
query("minsize_maxsize", _with(a.TREE) + "SELECT path, size FROM tree WHERE size >= 1024 AND size <= 4096")(lambda s, d: selection.sized(a.tree(s, d), fn.parse_size("1K"), fn.parse_size("4KB")).select("path", "size"))
query("find_in_path", _with(a.TREE) + "SELECT path FROM tree WHERE contains(path, '/fr/')")(lambda s, d: selection.containing(a.tree(s, d), "/fr/").select("path"))
query("find_replace_path", _with(a.TREE) + "SELECT doc_id, replace(path, '/en/', '/english/') AS path FROM tree")(lambda s, d: a.tree(s, d).select("doc_id", selection.replaced(F.col("path"), "/en/", "/english/").alias("path")))
query("rename_to", _with(a.TREE) + "SELECT doc_id, CASE WHEN starts_with(path, 'src1/') THEN 'one/' || substring(path, 6) WHEN starts_with(path, 'src') THEN 'all/' || substring(path, 4) ELSE path END AS path FROM tree")(lambda s, d: a.tree(s, d).select("doc_id", selection.renamed(F.col("path"), ["src1/", "src"], ["one/", "all/"]).alias("path")))
query("rename_prefix", _with(a.TREE) + "SELECT doc_id, 'restored/' || path AS path FROM tree")(lambda s, d: a.tree(s, d).select("doc_id", selection.renamed(F.col("path"), to=["restored/"]).alias("path")))
query("exclude_housekeeping", _with(a.TREE, "x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN split_part(path, '/', 1) || '/Thumbs.db' WHEN 1 THEN split_part(path, '/', 1) || '/@eaDir/' || doc_id ELSE path END AS path FROM tree)") + "SELECT doc_id, path FROM x WHERE doc_id % 4 > 1")(
    lambda s, d: selection.without_housekeeping(a.tree(s, d).join(a.table(s, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("/Thumbs.db"))).when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit("/@eaDir/"), F.col("doc_id").cast("string"))).otherwise(F.col("path")).alias("path")))
)
query("no_recursion", _with(a.TREE) + "SELECT path FROM (SELECT path FROM tree UNION ALL SELECT DISTINCT split_part(path, '/', 1) FROM tree) WHERE length(path) - length(replace(path, '/', '')) <= 1")(
    lambda s, d: selection.depth(a.tree(s, d).select("path").unionByName(a.tree(s, d).select(F.substring_index("path", "/", 1).alias("path")).distinct()), 1)
)
query("version_by_comment", _with(a.LOG) + "SELECT seq, ver FROM log WHERE ver IN (SELECT ver FROM (SELECT DISTINCT ver, 'backup ' || (ver % 7) AS comment FROM log) WHERE comment = 'backup 3')")(
    lambda s, d: a.log(s, d).join(a.log(s, d).select("ver").distinct().withColumn("comment", F.concat(F.lit("backup "), (F.col("ver") % 7).cast("string"))).filter("comment = 'backup 3'"), "ver", "left_semi").select("seq", "ver")
)
query("last_path", _with(a.TREE) + "SELECT max(path) AS path FROM tree")(lambda s, d: a.tree(s, d).agg(F.max("path").alias("path")))
query("exists_guard", _with(a.TREE) + "SELECT path FROM tree WHERE EXISTS (SELECT 1 FROM tree WHERE starts_with(path, 'src3/')) AND doc_id < 50")(
    lambda s, d: a.tree(s, d).filter("doc_id < 50").crossJoin(F.broadcast(a.tree(s, d).agg(F.bool_or(F.col("path").startswith("src3/")).alias("found")))).filter("found").select("path")
)
query("exists_guard_all", _with(a.TREE) + "SELECT path FROM tree WHERE EXISTS (SELECT 1 FROM tree WHERE starts_with(path, 'src3/'))")(
    lambda s, d: a.tree(s, d).select("path").crossJoin(F.broadcast(a.tree(s, d).agg(F.bool_or(F.col("path").startswith("src3/")).alias("found")))).filter("found").select("path")
)

# --- fragments and blocks ------------------------------------------------------------------------------------------

query("file_sizes_from_fragments", _with(a.REFS, a.FRAGMENTS) + "SELECT o_orderkey AS path, CAST(coalesce(sum(f.usize), 0) AS BIGINT) AS size FROM orders LEFT JOIN refs r ON r.path = o_orderkey LEFT JOIN fragments f ON f.frag_id = r.frag_id GROUP BY o_orderkey")(lambda s, d: fragments.file_sizes(a.files(s, d), a.refs(s, d), a.fragments(s, d)))
_ASOF = "placed AS (SELECT r.*, b.block_id, b.start FROM refs r ASOF JOIN blocks b ON r.frag_id >= b.start)"
query("fragment_to_block_asof", _with(a.REFS, a.BLOCKS, _ASOF) + "SELECT path, frag_id, block_id, start FROM placed")(lambda s, d: fragments.to_blocks(a.refs(s, d), a.blocks(s, d)).select("path", "frag_id", "block_id", "start"))
query("block_to_files", _with(a.REFS, a.BLOCKS, _ASOF) + "SELECT block_id, count(DISTINCT path) AS files, CAST(sum(DISTINCT path) AS BIGINT) AS path_sum FROM placed GROUP BY block_id")(lambda s, d: fragments.to_blocks(a.refs(s, d), a.blocks(s, d)).select("block_id", "path").distinct().groupBy("block_id").agg(F.count(F.lit(1)).alias("files"), F.sum("path").alias("path_sum")))
query("block_usize", _with(a.FRAGMENTS, a.BLOCKS) + "SELECT block_id, CAST(8 + sum(usize + 4) AS BIGINT) AS usize, count(*) AS frags FROM fragments f ASOF JOIN blocks b ON f.frag_id >= b.start GROUP BY block_id")(lambda s, d: fragments.block_sizes(fragments.to_blocks(a.fragments(s, d), a.blocks(s, d))))
query("fragment_offsets", _with(a.REFS) + f"SELECT path, frag_id, usize, CAST(coalesce(sum(usize) OVER (PARTITION BY path ORDER BY {a.ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frag_offset FROM refs")(lambda s, d: fragments.offsets(a.refs(s, d), a.REF_ORDER).select("path", "frag_id", "usize", "frag_offset"))
query("coalesced_runs", _with(a.REFS, a.BLOCKS, _ASOF, f"n AS (SELECT *, CASE WHEN lag(frag_id) OVER w + 1 = frag_id AND lag(block_id) OVER w = block_id THEN 0 ELSE 1 END AS new FROM placed WINDOW w AS (PARTITION BY path ORDER BY {a.ORDER_SQL}))", f"i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY {a.ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS run FROM n)") + "SELECT path, CAST(run AS BIGINT) AS run, min(block_id) AS block_id, min(frag_id) AS first_frag, count(*) AS frags, CAST(sum(usize) AS BIGINT) AS bytes FROM i GROUP BY path, run")(
    lambda s, d: fragments.runs(fragments.to_blocks(a.refs(s, d), a.blocks(s, d)), a.REF_ORDER)
)
query("blocks_needed", _with(a.REFS, a.BLOCKS, _ASOF) + "SELECT block_id, start, max(frag_id) - start + 1 AS frags_to_read, count(DISTINCT path) AS files FROM placed WHERE path % 97 = 0 GROUP BY block_id, start")(lambda s, d: fragments.needed_blocks(a.refs(s, d), a.files(s, d).filter("path % 97 = 0"), a.blocks(s, d)))
query("chunk_fixed", _with(a.CHUNKS) + "SELECT path, part, sha1(chunk) AS sha1, length(chunk) AS n FROM chunks")(lambda s, d: a.chunks(s, d).select("path", F.col("part").cast("long").alias("part"), F.sha1(F.col("chunk").cast("binary")).alias("sha1"), F.length("chunk").cast("long").alias("n")))
_RATIO = "SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS distinct_bytes, round(sum(n * size)::DOUBLE / sum(size)::DOUBLE, 6) AS ratio FROM g"
query("chunk_dedup_ratio", _with(a.CHUNKS, "g AS (SELECT sha1(chunk) AS h, count(*) AS n, octet_length(encode(any_value(chunk))) AS size FROM chunks GROUP BY 1)") + _RATIO)(lambda s, d: fragments.dedup_ratio(a.chunks(s, d), F.sha1(F.col("chunk").cast("binary")), F.octet_length("chunk")))
query("line_dedup_ratio", _with("lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)", "g AS (SELECT sha1(line) AS h, count(*) AS n, octet_length(encode(any_value(line))) AS size FROM lines GROUP BY 1)") + _RATIO)(lambda s, d: fragments.dedup_ratio(a.tree(s, d).select(F.explode(F.split("content", "\n")).alias("line")), F.sha1(F.col("line").cast("binary")), F.octet_length("line")))
query("new_fragments", _with(a.PAIR) + "SELECT DISTINCT sha1 FROM slave WHERE sha1 NOT IN (SELECT sha1 FROM master)")(lambda s, d: fragments.new_fragments(a.slave(s, d).select("sha1"), a.master(s, d)))

# --- comparison ----------------------------------------------------------------------------------------------------

_CMP = "cmp AS (SELECT coalesce(m.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'new' WHEN m.size = s.size AND m.sha1 = s.sha1 THEN 'equal' ELSE 'changed' END AS status FROM master m FULL JOIN slave s ON m.path = s.path)"
query("sync_tree", _with(a.PAIR, _CMP) + "SELECT * FROM cmp WHERE status <> 'equal'")(lambda s, d: compare.sync(a.master(s, d), a.slave(s, d)))
query("sync_tree_quick", _with(a.PAIR) + "SELECT coalesce(m.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'new' ELSE 'changed' END AS status FROM master m FULL JOIN slave s ON m.path = s.path WHERE s.path IS NULL OR m.path IS NULL OR m.size <> s.size")(lambda s, d: compare.sync(a.master(s, d), a.slave(s, d), quick=True))
query("verify_tree", _with(a.PAIR, _CMP) + "SELECT path, CASE status WHEN 'equal' THEN 'ok' WHEN 'changed' THEN 'different' ELSE 'missing' END AS status FROM cmp WHERE status <> 'new'")(lambda s, d: compare.verify(a.master(s, d), a.slave(s, d)))
query("compare_master_slaves", _with(a.PAIR, "sl AS (SELECT 'a' AS slave, path, size, sha1 FROM slave UNION ALL SELECT 'b', path, size, sha1 FROM tree WHERE doc_id % 3 <> 0)", "ma AS (SELECT n.slave, path, size, sha1 FROM master, (VALUES ('a'), ('b')) n(slave))") + "SELECT coalesce(m.slave, s.slave) AS slave, coalesce(m.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'new' WHEN m.size = s.size AND m.sha1 = s.sha1 THEN 'equal' ELSE 'changed' END AS status FROM ma m FULL JOIN sl s ON m.path = s.path AND m.slave = s.slave")(
    lambda s, d: compare.compare_many(a.master(s, d), {"a": a.slave(s, d), "b": a.tree(s, d).filter("doc_id % 3 <> 0")})
)
query("one_on_one_by_name", _with(a.PAIR) + "SELECT s.path AS path FROM slave s WHERE split_part(s.path, '/', 3) IN (SELECT split_part(path, '/', 3) FROM master)")(lambda s, d: compare.doubled(a.master(s, d), a.slave(s, d)).select("path"))
query("one_on_one_by_hash", _with(a.PAIR) + "SELECT path FROM slave WHERE sha1 IN (SELECT sha1 FROM master)")(lambda s, d: compare.doubled(a.master(s, d), a.slave(s, d), by_hash=True).select("path"))
query("kill_list", _with(a.PAIR) + "SELECT path FROM slave WHERE path NOT IN (SELECT path FROM master)")(lambda s, d: compare.extra(a.slave(s, d), a.master(s, d)).select("path"))
query("robocopy_plan", _with(a.PAIR, _CMP) + "SELECT path, CASE status WHEN 'missing' THEN 'copy' WHEN 'changed' THEN 'update' ELSE 'delete' END AS action FROM cmp WHERE status <> 'equal'")(lambda s, d: compare.mirror_plan(a.master(s, d), a.slave(s, d), kill=True))
query("empty_dirs", _with(a.TREE, "dirs AS (SELECT DISTINCT source || '/' || lang || '/' AS path FROM documents UNION SELECT DISTINCT source || '/empty' || (doc_id % 3) || '/' FROM documents UNION SELECT DISTINCT source || '/' FROM documents)") + "SELECT path FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE starts_with(t.path, d.path))")(
    lambda s, d: compare.empty_dirs(_dirs(s, d).unionByName(a.tree(s, d).select("path")))
)


def _dirs(s, d):
    docs = a.table(s, d, "documents")
    one = docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/")).alias("path"))
    two = docs.select(F.concat("source", F.lit("/empty"), (F.col("doc_id") % 3).cast("string"), F.lit("/")).alias("path"))
    return one.unionByName(two).unionByName(docs.select(F.concat("source", F.lit("/")).alias("path"))).distinct()


query("in_both", _with(a.PAIR) + "SELECT path, sha1 FROM master INTERSECT SELECT path, sha1 FROM slave")(lambda s, d: a.master(s, d).select("path", "sha1").intersect(a.slave(s, d).select("path", "sha1")))
query("only_in_master", _with(a.PAIR) + "SELECT path, sha1 FROM master EXCEPT SELECT path, sha1 FROM slave")(lambda s, d: a.master(s, d).select("path", "sha1").subtract(a.slave(s, d).select("path", "sha1")))
query("fragment_union", _with(a.PAIR) + "SELECT sha1 FROM master UNION SELECT sha1 FROM slave")(lambda s, d: a.master(s, d).select("sha1").unionByName(a.slave(s, d).select("sha1")).dropDuplicates(["sha1"]))
query("merge_parts", _with(a.LOG) + "SELECT ver % 3 AS part, count(*) AS entries, CAST(sum(seq) AS BIGINT) AS seqs FROM log GROUP BY 1")(lambda s, d: compare.merge_parts([a.log(s, d).filter(F.col("ver") % 3 == i).withColumn("part", F.lit(i).cast("long")) for i in range(3)]).groupBy("part").agg(F.count(F.lit(1)).alias("entries"), F.sum("seq").alias("seqs")))
query("part_gaps", "SELECT CAST(range AS BIGINT) AS part FROM range(1, (SELECT max(doc_id) FROM documents WHERE doc_id % 9 <> 4) + 1) WHERE range % 9 = 4")(lambda s, d: compare.part_gaps(a.table(s, d, "documents").filter("doc_id % 9 <> 4").select(F.col("doc_id").alias("part"))))
query("versum", _with(a.TREE, "list AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN upper(sha1) || ' x' ELSE sha1 END AS line FROM tree WHERE doc_id % 4 <> 0)") + "SELECT t.path, upper(regexp_replace(l.line, '[^0-9A-Fa-f]', '', 'g')) = upper(t.sha1) AS ok FROM tree t JOIN list l ON t.path = l.path")(
    lambda s, d: a.tree(s, d).join(a.tree(s, d).filter("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 13 == 0, F.concat(F.upper("sha1"), F.lit(" x"))).otherwise(F.col("sha1")).alias("line")), "path").select("path", (fn.hex_only(F.col("line")) == fn.hex_only(F.col("sha1"))).alias("ok"))
)

# --- reports -------------------------------------------------------------------------------------------------------

query("hash_files_sha1", _with(a.TREE) + "SELECT path, sha1 FROM tree")(lambda s, d: a.tree(s, d).select("path", "sha1").orderBy("path"))
query("hash_files_sha256", _with(a.TREE) + "SELECT path, sha256(content) AS sha256 FROM tree")(lambda s, d: a.tree(s, d).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")))
query("hash_files_md5", _with(a.TREE) + "SELECT path, md5(content) AS md5 FROM tree")(lambda s, d: a.tree(s, d).select("path", F.md5(F.col("content").cast("binary")).alias("md5")))
query("duplicate_groups", _with(a.TREE) + "SELECT sha1, count(*) AS copies, min(path) AS first_path, CAST((count(*) - 1) * any_value(size) AS BIGINT) AS wasted FROM tree GROUP BY sha1 HAVING count(*) > 1")(lambda s, d: report.duplicate_groups(a.tree(s, d)))
query("dedupe_keep_first", _with(a.TREE) + "SELECT sha1, min(path) AS path FROM tree GROUP BY sha1")(lambda s, d: report.keep_first(a.tree(s, d).select("sha1", "path")))
query("distinct_contents", _with(a.TREE) + "SELECT DISTINCT sha1, size FROM tree")(lambda s, d: a.tree(s, d).select("sha1", "size").distinct())
query("dir_sizes_depth1", _with(a.TREE) + "SELECT split_part(path, '/', 1) AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM tree GROUP BY 1")(lambda s, d: report.folder_sizes(a.tree(s, d)))
query("dir_sizes_cumulative", _with(a.TREE) + "SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT split_part(path, '/', 1) || '/' AS folder, size FROM tree UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/', size FROM tree) GROUP BY folder")(lambda s, d: report.folder_sizes_all(a.tree(s, d)))
query("order_by_ext_name", _with(a.TREE) + "SELECT path, row_number() OVER (ORDER BY split_part(path, '.', 2), split_part(path, '/', 3), path) AS n FROM tree QUALIFY n <= 50")(lambda s, d: report.ordered(a.tree(s, d), "ext;name").limit(50).select("path", F.row_number().over(Window.orderBy(fn.extension(F.col("path")), fn.file_name(F.col("path")), "path")).cast("long").alias("n")))
query("order_by_size_desc", _with(a.TREE) + "SELECT path, size FROM tree ORDER BY size DESC, path LIMIT 25")(lambda s, d: report.ordered(a.tree(s, d), "size", desc=True).limit(25).select("path", "size"))
query("order_by_ext_name_all", _with(a.TREE) + "SELECT path, row_number() OVER (ORDER BY split_part(path, '.', 2), split_part(path, '/', 3), path) AS n FROM tree")(lambda s, d: report.positions(report.ordered(a.tree(s, d), "ext;name").select("path")))
query("order_by_size_desc_all", _with(a.TREE) + "SELECT path, size, row_number() OVER (ORDER BY size DESC, path) AS n FROM tree")(lambda s, d: report.positions(report.ordered(a.tree(s, d), "size", desc=True).select("path", "size")))
query("decimate_keep_newest", _with(a.LOG) + "SELECT path, seq FROM log ORDER BY mtime DESC, path LIMIT 40")(lambda s, d: report.newest(a.log(s, d), 40).select("path", "seq"))
query("last2_rows", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS from_last FROM conversations QUALIFY from_last <= 2")(lambda s, d: report.last_rows(a.table(s, d, "conversations").select("conv_id", "turn"), "turn", "conv_id").withColumn("from_last", F.col("from_last").cast("long")))
query("count_string", "SELECT CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS found, sum((length(text) - length(replace(text, 'the', ''))) // 3) = 1000 AS ok FROM documents")(lambda s, d: report.count_string(a.tree(s, d), "the", 1000))
query("collision_check", _with(a.TREE, "x AS (SELECT substring(sha1, 1, 2) AS weak, sha1 AS strong FROM tree)") + "SELECT weak, count(DISTINCT strong) AS contents, count(*) AS files FROM x GROUP BY weak HAVING count(DISTINCT strong) > 1")(lambda s, d: report.collisions(a.tree(s, d).select(F.substring("sha1", 1, 2).alias("weak"), F.col("sha1").alias("strong")), "weak", "strong"))
query("format_summary", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(lambda s, d: report.summary(a.table(s, d, "events"), "event_type"))
query("csv_listing", _with(a.TREE) + "SELECT path || ';' || size || ';' || sha1 AS line FROM tree")(lambda s, d: report.csv_lines(a.tree(s, d), ["path", "size", "sha1"]))
query("chunk_volumes", _with(a.TREE) + "SELECT path, CAST(coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000000 + 1 AS BIGINT) AS volume FROM tree")(lambda s, d: report.volumes(a.tree(s, d), 1_000_000, "doc_id").select("path", "volume"))
query("extraction_report", _with(a.REFS, a.FRAGMENTS) + "SELECT path, count(*) FILTER (frag_id % 50 <> 0) AS extracted, count(*) AS total FROM refs GROUP BY path HAVING count(*) FILTER (frag_id % 50 <> 0) < count(*)")(lambda s, d: verify.extraction_report(a.refs(s, d).select("path", "frag_id"), a.fragments(s, d).filter("frag_id % 50 <> 0")))

# --- scalar functions ----------------------------------------------------------------------------------------------

query("path_parts", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_extract(url, '^(.*/)', 1) AS dir, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM pages")(lambda s, d: a.table(s, d, "pages").select("page_id", fn.file_name(F.col("url")).alias("name"), fn.file_dir(F.col("url")).alias("dir"), fn.stem(F.col("url")).alias("stem")))
query("thousands_format", "SELECT o_orderkey, replace(format('{:,}', CAST(o_orderkey * 1009 AS BIGINT)), ',', '.') AS n, lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS padded FROM orders")(lambda s, d: a.table(s, d, "orders").select("o_orderkey", fn.thousands(F.col("o_orderkey") * 1009).alias("n"), fn.padded(F.col("o_orderkey"), 4).alias("padded")))
query("date_placeholders", "SELECT event_id, 'v_' || strftime(ts, '%Y_%m_%d') || '_' || strftime(ts, '%H%M%S') AS name, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS date_int FROM events")(lambda s, d: a.table(s, d, "events").select("event_id", fn.fill_date(F.lit("v_%year_%month_%day_%hour%min%sec"), F.col("ts")).alias("name"), fn.date_int(F.col("ts")).alias("date_int")))
query("string_functions", "SELECT c_custkey, reverse(c_name) AS reversed, CASE WHEN instr(c_name, '0') > 0 THEN substring(c_name, 1, instr(c_name, '0') - 1) || 'zero' || substring(c_name, instr(c_name, '0') + 1) ELSE c_name END AS once, translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, rtrim('a/' || c_name, '/') || '/' || ltrim('/b', '/') AS joined FROM customer")(
    lambda s, d: a.table(s, d, "customer").select("c_custkey", F.reverse("c_name").alias("reversed"), fn.replace_first(F.col("c_name"), "0", "zero").alias("once"), fn.ascii_lower(F.col("c_mktsegment")).alias("lowered"), fn.join_path(F.concat(F.lit("a/"), "c_name", F.lit("/")), F.lit("/b")).alias("joined"))
)
query("number_functions", "SELECT p_partkey, CAST(length(bin(p_partkey)) AS BIGINT) * CAST(p_partkey > 0 AS BIGINT) AS bits, CAST(bit_count(p_partkey) AS BIGINT) AS ones, CAST(floor(32768 / (1 + exp(-(p_partkey % 4000 - 2000) / 64.0::DOUBLE))) AS BIGINT) AS squashed, CAST(p_size AS BIGINT) * 1024 AS bytes FROM part")(
    lambda s, d: a.table(s, d, "part").select("p_partkey", fn.bit_length(F.col("p_partkey")).cast("long").alias("bits"), F.bit_count("p_partkey").cast("long").alias("ones"), fn.squash((F.col("p_partkey") % 4000 - 2000).cast("double")).alias("squashed"), fn.size_bytes(F.concat(F.col("p_size").cast("string"), F.lit("K"))).alias("bytes"))
)
query("little_endian", "SELECT doc_id, CAST(('0x' || substring(h, 7, 2) || substring(h, 5, 2) || substring(h, 3, 2) || substring(h, 1, 2)) AS BIGINT) AS n FROM (SELECT doc_id, sha1(text) AS h FROM documents)")(lambda s, d: a.tree(s, d).select("doc_id", fn.little_endian(F.substring("sha1", 1, 8)).cast("long").alias("n")))

# --- verification --------------------------------------------------------------------------------------------------

query("fragment_verify", _with(a.FRAGMENTS) + "SELECT frag_id, frag_id % 17 <> 0 AS ok FROM fragments")(lambda s, d: verify.fragment_check(a.fragments(s, d).withColumn("content", F.when(F.col("frag_id") % 17 == 0, F.concat("content", F.lit("?"))).otherwise(F.col("content")))).select("frag_id", "ok"))
query("rebuild_and_hash", "SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 19 <> 0 AS ok FROM documents")(lambda s, d: verify.rebuild_check(a.tree(s, d).select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 19 == 0, F.lit("wrong")).otherwise(F.col("sha1")).alias("sha1")), a.chunks(s, d)))
query("block_order_check", _with("b AS (SELECT range AS block_id, CASE WHEN range % 10 = 3 THEN 64 * range - 10 ELSE 1 + 64 * range END AS start, CASE WHEN range % 10 = 7 THEN 0 ELSE 64 END AS frags, range * 100 AS offset, 100 AS bsize FROM range(200))", "o AS (SELECT *, lag(start + frags) OVER w AS e, lag(\"offset\" + bsize) OVER w AS p FROM b WINDOW w AS (ORDER BY start, block_id))") + "SELECT block_id, CASE WHEN start < 1 THEN 'bad start' WHEN frags < 1 THEN 'empty' WHEN start < e THEN 'overlap' ELSE 'order' END AS fault FROM o WHERE start < 1 OR frags < 1 OR start < e OR \"offset\" < p")(
    lambda s, d: verify.block_faults(s.range(200).select(F.col("id").alias("block_id"), F.when(F.col("id") % 10 == 3, 64 * F.col("id") - 10).otherwise(1 + 64 * F.col("id")).alias("start"), F.when(F.col("id") % 10 == 7, 0).otherwise(64).alias("frags"), (F.col("id") * 100).alias("offset"), F.lit(100).alias("bsize")))
)
query("global_hash", _with(a.TREE, "g AS (SELECT doc_id // 4096 AS run, sha256(string_agg(sha1, '' ORDER BY doc_id)) AS h FROM tree GROUP BY 1)") + "SELECT sha256(string_agg(h, '' ORDER BY run)) AS sha256, count(*) AS runs FROM g")(lambda s, d: verify.global_hash(a.tree(s, d), "doc_id"))
query("totals", _with(a.LOG) + "SELECT count(DISTINCT ver) AS versions, count(*) FILTER (NOT deleted) AS files, round(sum(size), 2) AS bytes FROM log")(lambda s, d: a.log(s, d).agg(F.count_distinct("ver").alias("versions"), F.count_if(~F.col("deleted")).alias("files"), F.round(F.sum("size"), 2).alias("bytes")))
query("crc32_files")(lambda s, d: a.tree(s, d).select("path", F.crc32(F.col("content").cast("binary")).alias("crc32")))
query("crc32_reconstructed")(lambda s, d: verify.crc32_of_parts(a.chunks(s, d)))
query("quick_hash")(lambda s, d: a.tree(s, d).select("path", fn.quick_hash(F.col("content")).alias("quick")))
query("cdc_chunk")(lambda s, d: chunking.content_chunks(a.tree(s, d)).select("path", "part", "sha1", F.octet_length("chunk").alias("bytes")))
query("codec_ratio")(lambda s, d: chunking.compressed_sizes(a.tree(s, d)))

# --- extras that the catalogue engine gets from Spark itself ---------------------------------------------------------

query("extra_rank_in_version", _with(a.LOG) + "SELECT seq, ver, CAST(rank() OVER (PARTITION BY ver ORDER BY size DESC) AS BIGINT) AS r FROM log")(lambda s, d: a.log(s, d).select("seq", "ver", F.rank().over(Window.partitionBy("ver").orderBy(F.desc("size"))).cast("long").alias("r")))
query("extra_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")(lambda s, d: a.table(s, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n")))
query("extra_tumbling", "SELECT CAST(strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y%m%d%H%M%S') AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1")(lambda s, d: a.table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(fn.date_int(F.col("w.start")).alias("start"), "n"))
query("extra_approx_paths")(lambda s, d: a.log(s, d).agg(F.approx_count_distinct("path").alias("paths")))
