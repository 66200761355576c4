import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidelog.functions import scalar as fn
from tidelog.operators import chunking, fragments, journal, report, selection, verify
from tidelog.plans import adapters
from tidelog.sources import files
from tidelog.streaming import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_until_in_all_forms():
    import datetime as dt

    last = lambda *d: dt.datetime(*d)
    for words, want in {
        ("20240105",): last(2024, 1, 5, 23, 59, 59),
        ("2024/1/5",): last(2024, 1, 5, 23, 59, 59),
        ("2024", "1", "5"): last(2024, 1, 5, 23, 59, 59),
        ("2024-01-05 9:30",): last(2024, 1, 5, 9, 30, 59),
        ("2024", "1", "5", "9", "30", "7"): last(2024, 1, 5, 9, 30, 7),
        ("2024-01-05", "09:30:07"): last(2024, 1, 5, 9, 30, 7),
        ("20240231",): last(2024, 2, 29, 23, 59, 59),
        ("20241301",): last(2024, 12, 31, 23, 59, 59),
        ("20240100",): last(2023, 12, 31, 23, 59, 59),
        ("2024010525",): last(2024, 1, 5, 23, 59, 59),
        ("20240105106107",): last(2024, 1, 5, 10, 59, 59),
        ("202401",): 202401,
        ("2024", "1"): 202401,
        ("1234567",): 1234567,
        ("7",): 7,
        ("-1",): -1,
    }.items():
        assert selection.parse_until(*words) == want, words
    for bad in (("18991231",), ("30000101",), ("123456789012345",), ("-0",), ("-x",), ("no date",), ("-1", "2")):
        with pytest.raises(ValueError):
            selection.parse_until(*bad)


def test_a_glob_ends_where_the_path_ends(spark):
    df = spark.createDataFrame([("a",), ("a\n",), ("a/b\n",), ("ab",), ("a/",), (None,)], "path string")
    got = [r["path"] for r in df.filter(selection.matches(F.col("path"), "a")).collect()]
    assert got == ["a", "a/b\n", "a/"]


def test_tags_at_every_byte(spark):
    rows = [(1, bytes.fromhex("A11111")), (2, b"aaaa"), (3, None), (4, b""), (5, bytes.fromhex("1A111A11"))]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r["id"]: r["tag_at"] for r in files.find_tag(df, b"\x11\x11").collect()}
    assert got == {1: [1], 2: [], 3: [], 4: [], 5: []}
    assert {r["id"]: r["tag_at"] for r in files.find_tag(df, b"aa").collect()}[2] == [0, 1, 2]
    held = {r["id"]: r["payload"] for r in files.payload(spark.createDataFrame([(1, b"exeTAGxTAGdata"), (2, b"none"), (3, b"TAG")], "id int, content binary"), b"TAG").collect()}
    assert held == {1: bytearray(b"data"), 2: None, 3: bytearray(b"")}
    with pytest.raises(ValueError):
        files.find_tag(df, b"")


def test_writes_are_capped(spark):
    rows = [("f", i, i + 1, "b", n) for i, n in enumerate([5, 5, 5, 20, 1, 1, 9])] + [("g", 0, 3, "b", 4), ("g", 1, 9, "b", None)]
    refs = spark.createDataFrame(rows, "path string, part int, frag_id long, block_id string, usize long")
    got = sorted((r["path"], r["first_frag"], r["frags"], r["bytes"]) for r in fragments.runs(refs, ["part"], most=12).collect())
    assert got == [("f", 1, 2, 10), ("f", 3, 1, 5), ("f", 4, 1, 20), ("f", 5, 3, 11), ("g", 3, 1, 4), ("g", 9, 1, None)]
    assert fragments.runs(refs, ["part"]).count() == 3


def test_block_structure(spark):
    rows = [(1, 1, 0, 10), (2, 5, 10, -1), (3, 0, 10, 5), (4, 99, 15, 5), (5, 7, 20, 5), (6, 7, 25, 5), (7, 9, 26, 5), (8, 12, 31, 5)]
    got = {r["block_id"]: r["fault"] for r in verify.block_check(spark.createDataFrame(rows, "block_id int, start int, offset int, bsize int"), 20).collect()}
    assert got == {2: "negative block size", 3: "block starts at fragment 0", 4: "block start too high", 5: "unordered frags", 6: "empty block", 7: "unordered blocks"}


def test_files_are_written_with_parents_and_dates(spark, tmp_path):
    import datetime as dt

    when = dt.datetime(2024, 2, 3, 4, 5, 6)
    rows = [("a/b/c.txt", b"one", when), ("d.txt", None, None), ("../out", b"x", None), ("/abs/e", b"y", when), (None, b"z", None)]
    df = spark.createDataFrame(rows, "path string, content binary, mtime timestamp")
    for _ in range(2):  # a second run replaces the files
        got = {r["path"]: (r["bytes"], r["error"] is None) for r in files.write_files(df, str(tmp_path / "t")).collect()}
    assert got == {"a/b/c.txt": (3, True), "d.txt": (0, True), "../out": (None, False), "/abs/e": (1, True), None: (None, False)}
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "t") for d, _, fs in os.walk(tmp_path / "t") for f in fs}
    assert found == {"a/b/c.txt", "d.txt", "abs/e"} and not os.path.exists(tmp_path / "out")
    assert os.path.getmtime(tmp_path / "t/a/b/c.txt") == when.replace(tzinfo=dt.timezone.utc).timestamp()


def test_lists_and_databases_and_commands(spark):
    tree = spark.createDataFrame([("a/b/c",), ("a/d",), ("e",), ("ab/x",)], "path string")
    names = spark.createDataFrame([("a/b/",), ("e",), ("e",), ("none",)], "path string")
    assert sorted(r["path"] for r in files.listed(tree, names).collect()) == ["a/b/c", "e"]
    bases = spark.createDataFrame([("mysql",), ("Sys",), ("shop",), ("shop_test",), ("blog",)], "name string")
    assert [r["name"] for r in files.chosen_databases(bases, ["s*", "sys"], ["*_test"]).collect()] == ["shop"]
    out = files.piped(tree, ["tr", "a-z", "A-Z"], "path").collect()
    assert [r["output"] for r in out] == ["A/B/C", "A/D", "E", "AB/X"]
    assert files.piped(tree, ["false"], "path").first()["output"] is None


def test_keys_and_digests(spark):
    row = spark.createDataFrame([(b"password", b"NaCl", b"abc")], "word binary, salt binary, data binary")
    key = row.select(fn.stretched_key(F.col("word"), F.col("salt"), 1024, 8, 16, 64).alias("k")).first()["k"]
    assert key.startswith("fdbabe1c9d3472007856e7190d01e9fe7c6ad7cbc8237830e77376634b373162")  # RFC 7914
    got = row.select(fn.digests(F.col("data")).alias("d")).first()["d"]
    assert got["sha3_256"] == hashlib.sha3_256(b"abc").hexdigest() and got["blake2b"] == hashlib.blake2b(b"abc").hexdigest()


def test_the_code_filter_and_back():
    import random

    assert chunking.e8e9(b"\x90\xe8\x01\x00\x00\x00") == b"\x90\xe8\x02\x00\x00\x00"
    assert chunking.e8e9(b"\xe8\x01\x00\x00\x07") == b"\xe8\x01\x00\x00\x07"
    rnd = random.Random(1)
    for _ in range(500):
        data = bytes(rnd.choice([0xE8, 0xE9, 0, 255, rnd.randrange(256)]) for _ in range(rnd.randrange(60)))
        assert chunking.e8e9(chunking.e8e9(data), back=True) == data


def test_running_total_and_tree_of_hashes(spark):
    rows = [(i * 3, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "part long, size long")
    got = {r["part"]: r["before"] for r in report.running_total(df, "part", "size", ranges=9).collect()}
    total = 0
    for part, size in rows:
        assert got[part] == total
        total += size
    hashes = spark.createDataFrame([(i, hashlib.sha1(bytes([i])).hexdigest()) for i in range(50)], "part long, sha1 string")
    level = [hashlib.sha1(bytes([i])).hexdigest() for i in range(50)]
    first = True
    while first or len(level) > 3:
        level = [hashlib.sha256("".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
        first = False
    want = hashlib.sha256("".join(level).encode()).hexdigest()
    out = verify.global_hash(hashes, groups=3).first()
    assert out["sha256"] == want and out["runs"] == 17
    assert report.running_total(df.limit(0), "part", "size").count() == 0


def test_plans_of_the_journal(spark):
    log = adapters.log(spark, "/root/testdata/sf0.001")
    versions = journal.version_table(log)
    for df in (journal.snapshot(log), journal.snapshot(journal.until_version(log, -3)), journal.version_range(log, tail=2), journal.until_date(log, versions, selection.parse_until("20240110"))):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Sort " not in plan and "SortAggregate" not in plan and "CartesianProduct" not in plan
    blocks, refs = adapters.blocks(spark, "/root/testdata/sf0.001"), adapters.refs(spark, "/root/testdata/sf0.001")
    plan = plan_of(fragments.to_blocks(refs, blocks))
    assert "NestedLoop" not in plan and "Window" not in plan


def test_streams_of_trees_and_fragments(spark, tmp_path):
    trees = [[("a", 1), ("b", 1)], [("a", 2), ("c", 1)], [("a", 2)], [("a", 2), ("d", 4)]]
    for i, rows in enumerate(trees):
        spark.createDataFrame(rows, "path string, size int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    import shutil

    os.makedirs(tmp_path / "src")
    for i in range(len(trees)):
        part = next(f for f in os.listdir(tmp_path / f"in/{i}.parquet") if f.startswith("part"))
        shutil.copy(tmp_path / f"in/{i}.parquet/{part}", tmp_path / f"src/{i}.parquet")
        os.utime(tmp_path / f"src/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = catalog.log_stream(spark, f"{tmp_path}/src", "path string, size int")
    catalog.stream_changes(stream, ["size"], f"{tmp_path}/changes", f"{tmp_path}/cp1").awaitTermination()
    got = [sorted((r["path"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/changes/batch={i}").collect()) for i in range(4)]
    assert got == [[("a", "added"), ("b", "added")], [("a", "changed"), ("b", "deleted"), ("c", "added")], [("c", "deleted")], [("d", "added")]]
    assert sorted(os.listdir(f"{tmp_path}/changes_trees")) == ["tree=2", "tree=3"]
    spark.createDataFrame([(f"h{i % 3}", f"2024-01-01 00:0{i}:00") for i in range(6)], "sha1 string, t string").selectExpr("sha1", "CAST(t AS TIMESTAMP) AS t").coalesce(1).write.parquet(f"{tmp_path}/frags")
    seen = catalog.stream_new_fragments(catalog.log_stream(spark, f"{tmp_path}/frags", "sha1 string, t timestamp"), time="t", keep="1 hour")
    assert sorted(r["sha1"] for r in catalog.run_to_table(seen, "seen_frags", "append", f"{tmp_path}/cp2").collect()) == ["h0", "h1", "h2"]
    counts = catalog.stream_windows(catalog.log_stream(spark, f"{tmp_path}/frags", "sha1 string, t timestamp"), "t", "1 minute", "2 minutes")
    assert sorted(r["n"] for r in catalog.run_to_table(counts, "seen_windows", "complete", f"{tmp_path}/cp3").collect()) == [2, 2, 2]


def test_csv_text_and_error_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "path string, size int")
    files.export_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("sep", ";").option("header", "true").csv(f"{tmp_path}/csv").count() == 2
    for append in (False, True):
        files.export_text(df, f"{tmp_path}/text", append)
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/text").collect()) == ["a\t1", "a\t1", "b", "b"]
    good = files.errors(df, F.col("size").isNull(), f"{tmp_path}/bad")
    assert good.count() == 1 and spark.read.parquet(f"{tmp_path}/bad").count() == 1
    (tmp_path / "list.txt").write_text("a\n\n  b \n")
    assert [r["path"] for r in files.path_list(spark, f"{tmp_path}/list.txt").collect()] == ["a", "b"]
    assert report.listing(df, ["path"]).count() == 2 and selection.without_dirs(spark.createDataFrame([("d/",), ("f",)], "path string")).count() == 1
