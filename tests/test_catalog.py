"""The catalogue engine on small hand-made tables."""

import datetime as dt
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.functions import scalar as fn
from tidelog.operators import chunking, compare, fragments, journal, report, selection, verify
from tidelog.sources import files
from tidelog.streaming import catalog

LOG = "seq long, ver long, path string, deleted boolean, size long, mtime timestamp"
T = [dt.datetime(2024, 1, d) for d in (1, 5, 3, 9)]
ROWS = [(1, 1, "a", False, 1, T[0]), (2, 1, "b", False, 2, T[0]), (3, 2, "a", True, None, T[1]), (4, 3, "a", False, 7, T[2]), (5, 4, "b", False, 2, T[3])]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(ROWS, LOG)


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_snapshots_fold_the_log(log):
    for n in range(5):
        state = {}
        for seq, ver, path, deleted, *_ in ROWS:
            if ver <= n:
                state[path] = (seq, deleted)
        want = sorted((p, s) for p, (s, gone) in state.items() if not gone)
        assert sorted((r["path"], r["seq"]) for r in journal.snapshot(journal.until_version(log, n)).collect()) == want


def test_date_cut_is_a_prefix(log):
    versions = journal.version_table(log)
    cut = journal.until_date(log, versions, selection.parse_until("20240104"))
    assert {r["ver"] for r in cut.collect()} == {1}  # version 3 is earlier than the date, but behind version 2
    assert {r["ver"] for r in journal.until_version(log, -1).collect()} == {1, 2, 3}


def test_incomplete_version_ends_the_log(spark, log):
    versions = spark.createDataFrame([(1, 5), (2, 5), (3, -1), (4, 5)], "ver long, csize long")
    assert {r["ver"] for r in journal.complete(log, versions).collect()} == {1, 2}


def test_changes(log):
    assert [r["change"] for r in journal.version_changes(log).orderBy("seq").collect()] == ["added", "added", "deleted", "added", "same"]


def port(pattern, path):
    """The rule by recursion: descendants match, case doesn't count."""

    def match(i, j):
        if i == len(pattern):
            return j == len(path) or path[j] == "/" or (i > 0 and pattern[-1] == "/")
        if pattern[i] == "*":
            return any(match(i + 1, k) for k in range(j, len(path) + 1))
        return j < len(path) and (pattern[i] == "?" or pattern[i].lower() == path[j].lower()) and match(i + 1, j + 1)

    return match(0, 0)


def test_globs_against_recursion():
    import re

    rnd = random.Random(3)
    for _ in range(3000):
        pattern = "".join(rnd.choice("ab/*?.") for _ in range(rnd.randint(0, 5)))
        path = "".join(rnd.choice("aAb/.") for _ in range(rnd.randint(0, 6)))
        assert bool(re.match(selection.glob_regex(pattern).replace(r"\z", r"\Z"), path)) == port(pattern, path), (pattern, path)


def test_selection_lists(spark):
    df = spark.createDataFrame([(p,) for p in ("a/x.txt", "a/y.bin", "b/x.txt", "A/z.TXT")], "path string")
    assert paths(selection.select_paths(df, ["a"], ["*.txt"], ["*x.txt"])) == ["A/z.TXT"]
    assert paths(selection.select_paths(df)) == sorted(["a/x.txt", "a/y.bin", "b/x.txt", "A/z.TXT"])


def test_ranges_and_dates():
    assert selection.parse_range("2:3") == (2, 3, None) and selection.parse_range("2:") == (2, None, None)
    assert selection.parse_range(":2") == (None, 2, None) and selection.parse_range("2") == (2, 2, None) and selection.parse_range("::1") == (None, None, 1)
    assert selection.parse_until("2024", "1", "5") == dt.datetime(2024, 1, 5, 23, 59, 59)
    assert selection.parse_until("20240105", "10") == dt.datetime(2024, 1, 5, 10, 59, 59) and selection.parse_until("-1") == -1
    with pytest.raises(ValueError):
        selection.parse_until("18990101")


def test_file_sizes_with_unknown_parts(spark):
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    r = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 0), ("a", 99)], "path string, frag_id long")
    g = spark.createDataFrame([(1, 10), (2, 5), (3, None)], "frag_id long, usize long")
    assert {x["path"]: x["size"] for x in fragments.file_sizes(f, r, g).collect()} == {"a": 15, "b": None, "c": 0}


def test_blocks_runs_and_offsets(spark):
    b = spark.createDataFrame([(0, 1), (1, 4), (2, 2000)], "block_id long, start long")
    r = spark.createDataFrame([("f", i, x, 10) for i, x in enumerate([1, 2, 3, 4, 5, 9, 3000, 2000])], "path string, o int, frag_id long, usize long")
    placed = fragments.to_blocks(r, b)
    assert [x["block_id"] for x in placed.orderBy("o").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
    runs = fragments.runs(placed, ["o"]).orderBy("run").collect()
    assert [(x["first_frag"], x["frags"], x["bytes"]) for x in runs] == [(1, 3, 30), (4, 2, 20), (9, 1, 10), (3000, 1, 10), (2000, 1, 10)]
    assert [x["frag_offset"] for x in fragments.offsets(r, ["o"]).orderBy("o").collect()] == list(range(0, 80, 10))


def test_compare_is_empty_on_itself_and_plans(spark):
    a = spark.createDataFrame([("x", 1, "h1"), ("y", 2, "h2"), ("z", 3, "h3")], "path string, size long, sha1 string")
    b = spark.createDataFrame([("x", 1, "h1"), ("y", 2, "h9"), ("w", 3, "h3")], "path string, size long, sha1 string")
    assert compare.sync(a, a).count() == 0
    assert {r["path"]: r["status"] for r in compare.sync(a, b).collect()} == {"y": "changed", "z": "missing", "w": "new"}
    assert {r["path"]: r["status"] for r in compare.sync(a, b, quick=True).collect()} == {"z": "missing", "w": "new"}
    assert {r["path"]: r["action"] for r in compare.mirror_plan(a, b, kill=True).collect()} == {"y": "update", "z": "copy", "w": "delete"}
    assert paths(compare.doubled(a, b, by_hash=True)) == ["w", "x"] and paths(compare.extra(b, a)) == ["w"]


def test_empty_folders(spark):
    t = spark.createDataFrame([("a/",), ("a/b/",), ("a/b/f",), ("c/",), ("c/d/",)], "path string")
    assert paths(compare.empty_dirs(t)) == ["c/", "c/d/"]


def test_crc_combination():
    rnd = random.Random(1)
    for _ in range(50):
        x, y = rnd.randbytes(rnd.randint(0, 40)), rnd.randbytes(rnd.randint(0, 40))
        assert verify.crc32_combine(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


def test_crc_of_parts_and_rebuild(spark):
    docs = spark.createDataFrame([("p", "héllo wörld" * 50), ("q", ""), ("r", "x")], "path string, content string")
    parts = fragments.fixed_chunks(docs, 7)
    got = {r["path"]: r["crc32"] for r in verify.crc32_of_parts(parts).collect()}
    assert got == {"p": zlib.crc32(("héllo wörld" * 50).encode()), "r": zlib.crc32(b"x")}
    stored = docs.withColumn("sha1", F.sha1(F.col("content").cast("binary")))
    assert all(r["ok"] for r in verify.rebuild_check(stored, parts).collect())


def test_content_chunks():
    rnd = random.Random(2)
    data = rnd.randbytes(60_000)
    ends = chunking.cut_points(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= chunking.MOST and min(sizes[:-1]) >= chunking.LEAST
    cut = lambda d: {d[a:b] for a, b in zip([0, *chunking.cut_points(d)], chunking.cut_points(d))}
    assert len(cut(data) - cut(data[:30_000] + b"edit" + data[30_000:])) <= 4
    assert chunking.cut_points(b"") == [] and chunking.cut_points(b"x") == [1]


def test_bwt_round_trip_and_sparse():
    rnd = random.Random(4)
    for data in (b"", b"a", b"banana", b"\0\0\0", rnd.randbytes(500), b"ab" * 300):
        assert chunking.unbwt(*chunking.bwt(data)) == data
    assert chunking.sparse_runs(bytes(4096) + b"x" * 4096 + bytes(4096) + bytes(10)) == [(4096, 4096), (12288, 10)]


def test_scalars(spark):
    row = spark.createDataFrame([("dir/a.tar.gz", 1234567, "01C3A900", "x,,y,")], "p string, n long, h string, l string").select(
        fn.file_name(F.col("p")).alias("a"), fn.file_dir(F.col("p")).alias("b"), fn.stem(F.col("p")).alias("c"), fn.thousands(F.col("n")).alias("d"), fn.padded(F.col("n"), 3).alias("e"), fn.little_endian(F.col("h")).cast("long").alias("f"), fn.split_list(F.col("l"), ",").alias("g"),
        fn.elapsed(F.lit(3725).cast("long")).alias("i"), fn.size_bytes(F.lit("12 KB")).alias("j"), fn.all_zero(F.lit("0000")).alias("k"), fn.replace_first(F.lit("aXbX"), "X", "-").alias("m"), fn.to_little_endian(F.lit(258), 4).alias("o"), fn.padded(F.lit(0), 0).alias("q"),
    ).first()
    assert tuple(row) == ("a.tar.gz", "dir/", "a.tar", "1.234.567", "1234567", 0x00A9C301, ["x", "", "y"], "01:02:05", 12288, True, "a-bX", "02010000", "")


def test_multipart_and_tree(spark, tmp_path):
    for n, data in ((1, b"aaa"), (2, b"bb"), (4, b"c")):
        (tmp_path / f"arc{n:02}").write_bytes(data)
    parts = files.multipart(spark, f"{tmp_path}/arc??").orderBy("part").collect()
    assert [(p["part"], p["offset"]) for p in parts] == [(1, 0), (2, 3)]
    assert files.tree(spark, str(tmp_path)).count() == 3
    blob = spark.createDataFrame([(bytearray(b"..TAG...TAG"),)], "content binary")
    assert files.find_tag(blob, b"TAG").first()["tag_at"] == [2, 8]


def test_catalog_versions_and_stream(spark, log, tmp_path):
    at = str(tmp_path / "cat")
    for v in (1, 2, 3, 4):
        files.append_version(log.filter(F.col("ver") == v).drop("ver"), at, v)
    assert files.catalog(spark, at, until=2).count() == 3
    flat = str(tmp_path / "flat")
    for v in (1, 2, 3, 4):
        log.filter(F.col("ver") == v).coalesce(1).write.mode("append").parquet(flat)
    stream = catalog.log_stream(spark, flat, log.schema)
    got = catalog.run_to_table(catalog.stream_latest(stream), "latest_paths", "complete", str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in got.select("path", "seq").collect()) == [("a", 4), ("b", 5)]
    catalog.maintain(stream, str(tmp_path / "state"), str(tmp_path / "cp2")).awaitTermination()
    last = max(os.listdir(tmp_path / "state"), key=lambda x: int(x.split("=")[1]) if "=" in x else -1)
    assert sorted((r["path"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/state/{last}").collect()) == [("a", 4), ("b", 5)]


def test_folder_totals(spark):
    t = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("z", 4)], "path string, size long")
    assert {r["folder"]: (r["files"], r["bytes"]) for r in report.folder_sizes_all(t).collect()} == {"a/": (2, 3), "a/b/": (1, 1)}
    assert {r["folder"]: r["bytes"] for r in report.folder_sizes(t).collect()} == {"a": 3, "": 4}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_guard_returns_every_path(spark):
    from tidelog.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = paths(QUERIES["exists_guard_all"](spark, sf))
    assert len(got) == docs > 50 and any(p.startswith("src3/") for p in got)


def test_whole_listings_are_ordered(spark):
    from tidelog.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {f"{r['source']}/{r['lang']}/{r['doc_id']}.txt": len(r["text"].encode()) for r in docs}
    got = {r["path"]: r["n"] for r in QUERIES["order_by_ext_name_all"](spark, sf).collect()}
    assert got == {p: i + 1 for i, p in enumerate(sorted(size, key=lambda p: (p.split(".")[1], p.split("/")[2], p)))}
    got = {(r["path"], r["size"]): r["n"] for r in QUERIES["order_by_size_desc_all"](spark, sf).collect()}
    assert got == {(p, size[p]): i + 1 for i, p in enumerate(sorted(size, key=lambda p: (-size[p], p)))} and len(got) > 50
