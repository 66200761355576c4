import hashlib

import numpy as np
import pytest
import xxhash

from tidelog.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, keep_id string, name int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", None, "Abc", "aBC", "É", "é", "x" * 700, "X" * 700, "x" * 701, "ab" * 300 + "c", "ab" * 300 + "d", " ", "a b c"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


def brute_groups(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return {i: (max(g), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}


def test_exact_dedup_against_brute_force(spark):
    for block in (1, 7, 64, 4096):
        texts = TEXTS if block > 1 else ["", "ab", "AB", "ba", "aab", None]
        want = brute_groups(texts)
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts), block).collect()}
        assert {i: (r["keep_id"], r["group_size"], r["text_sha256"]) for i, r in got.items()} == want
        assert all(r["kept"] == (i == r["keep_id"]) for i, r in got.items())


def test_exact_dedup_of_repeated_rows_nulls_and_nothing(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, "A")]
    got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 2, 4, False), (1, 1, 1, True), (1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True)]
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_print(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(runs))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rnd.integers(0, 500, 300)) for _ in range(6)]
    texts = [*TEXTS, *base, *(b.replace(" w1", " Q1", 1) for b in base), *(b + " tail" for b in base), base[0].upper(), "one two", "ONE two", " ".join(f"v{i}" for i in range(70_000))]
    prints = [brute_print(t) for t in texts]
    want = brute_components(prints)
    got = {r["doc_id"]: r for r in simhash.near_dedup(docs(spark, texts)).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == set(want)


@pytest.mark.parametrize("dealt", [{}, {"bucket_rows": 2000, "level": 3, "gather": 5000}])
def test_links_within_three_bits_and_no_others(spark, dealt):
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 60, dtype=np.uint64)
    more = [base]
    for _ in range(6):
        x = base.copy()
        for _ in range(rnd.integers(1, 5)):
            x ^= np.uint64(1) << rnd.integers(0, 64, len(x), dtype=np.uint64)
        more.append(x)
    prints = sorted(set(np.concatenate(more).view(np.int64).tolist()))
    links = simhash.components(simhash.link(spark.createDataFrame([(x,) for x in prints], "fp long"), **dealt))
    root = dict.fromkeys(prints)
    root.update({r["a"]: r["b"] for r in links.collect()})
    want = brute_components([x % (1 << 64) for x in prints])
    assert [root[x] if root[x] is not None else x for x in prints] == [prints[i] for i in want]


def test_simhash_of_nothing(spark):
    assert simhash.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


REPEATS = [(1, "a b c d", "x"), (1, "a b c d", "y"), (1, "other words here", "x"), (2, "A b c d", "x"), (2, "a B c d", "x"), (None, "a b c d", "x"), (None, "only without an id", "x"), (None, "only without an id", "x")]


def test_one_row_of_each_group_where_doc_ids_repeat(spark):
    df = spark.createDataFrame(REPEATS, "doc_id long, text string, tag string")
    exact = [tuple(r) for r in exact_dedup.keep_one(df).collect()]
    assert sorted((i or 0, t.translate(LOWER)) for i, t, _ in exact) == [(0, "only without an id"), (1, "other words here"), (2, "a b c d")]
    near = [tuple(r) for r in simhash.keep_one(df).collect()]
    want = brute_components([brute_print(t) for _, t, _ in REPEATS])
    assert len(near) == len(set(want)) == 3
    assert sorted((i or 0, t) for i, t, _ in near) == [(0, "only without an id"), (1, "a b c d"), (1, "other words here")]
    assert exact_dedup.keep_one(df.limit(0)).columns == simhash.keep_one(df.limit(0)).columns == df.columns


def test_components_of_a_chain_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 50)]
    got = {r["a"]: r["b"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)}}
