import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidelog.llm import bpe, kept_chunks, token_coder, token_output

TEXTS = ["", None, "a", " ", "  ", "   x", "a\n \nb", "a  \n", "tab\t\t x", "Ünïcode 漢字 😀  ok", "it's we'll 123 45", "\x1c \x85", "<|endoftext|> x", "a<|endoftext|>b c", "word " * 3000, "z" * 3000, "a　  b"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int, start int")


def random_texts(n, seed=1):
    rnd, letters = random.Random(seed), [*"ab cdé漢字'st \n\t \x1c\x1d\x85 12.,!?ßΩ😀  ", "'s", "'ll", " the"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_bpe_is_as_the_library_has_it():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.ByteBPE(bpe.read_ranks(path), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in [t or "" for t in TEXTS] + random_texts(3000):
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_bpe_query_form(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark), path, P.PATTERN).collect()}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS))
    assert got[0]["n_tokens"] == 0 and bpe.round_trip(frame(spark, []), path, P.PATTERN).count() == 0
    assert bpe.encode(frame(spark), path, P.PATTERN).count() == len(TEXTS)


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 7000])
def test_coder_round_trip(n):
    rnd = np.random.default_rng(n)
    for ids in (np.minimum(rnd.zipf(1.3, n), 65000), rnd.integers(0, 65535, n), np.full(n, 9), np.arange(n) % 13):
        data = token_coder.encode(ids)
        assert np.array_equal(token_coder.decode(data), ids)
    assert n < 2000 or len(data) < n / 4


def test_coder_finds_damage():
    data = bytearray(token_coder.encode(np.arange(5000) % 700))
    data[-40] ^= 255
    with pytest.raises(ValueError):
        token_coder.decode(bytes(data))
    data = bytearray(token_coder.encode(np.arange(5000) % 700))
    data[40] ^= 255
    with pytest.raises(ValueError):
        token_coder.decode(bytes(data))
    for bad in (-1, 1 << 32):
        with pytest.raises(ValueError):
            token_coder.encode(np.array([bad]))


def test_coder_takes_ids_of_32_bits_and_beats_zlib():
    rnd = np.random.default_rng(5)
    wide = rnd.choice(rnd.integers(0, 1 << 32, 70_000), 150_000)
    assert np.array_equal(token_coder.decode(token_coder.encode(wide)), wide)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    words = ["".join(rnd.choice(["the", "an", "re", "ti", "on", "sh"], rnd.integers(1, 4))) for _ in range(900)]
    ids = np.array(library.encode(" ".join(rnd.choice(words, 60_000)), add_special_tokens=False).ids)
    plain = sum(len(zlib.compress(ids[i : i + token_coder.BLOCK].astype("<u2").tobytes())) for i in range(0, len(ids), token_coder.BLOCK))
    assert len(token_coder.encode(ids)) < 0.9 * plain


def test_a_hot_doc_id_fills_several_shards(spark, tmp_path):
    path, out = P.path("byte_bpe_50k.json"), f"file://{tmp_path}/hot"
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 300 + [(9, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_output.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), out, path, frame=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_output.read_index(spark, out).collect()
    assert len(got) == len(rows) and len({r["start"] for r in got}) == len(rows)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None] * 300 + [7] * 300 + [9]
    assert spark.read.parquet(out).filter("array_contains(doc_ids, 7)").select("shard").distinct().count() > 1


def test_token_files(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = TEXTS + random_texts(300, 2)
    out = f"file://{tmp_path}/ids"
    token_output.write(frame(spark, texts), out, path, frame=500)
    got = token_output.read_index(spark, out).orderBy("doc_id").collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [r["n_tokens"] for r in got] == [len(x) for x in ids]
    assert [r["start"] for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert {r["doc_id"]: r["ids"] for r in token_output.read_ids(spark, out).collect()} == dict(enumerate(ids))


def test_tokens_are_as_the_library_has_them():
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        own = token_output.Tokens(f.read())
    texts = [t or "" for t in TEXTS] + random_texts(5000, 3)
    for part in (texts[:40], texts[40:], texts):  # chunks of several texts meet
        ids, n = own.encode(pa.array(part, pa.string()))
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
        assert part == texts[40:] or sum(x.count(50256) for x in want) >= 2  # the library makes tokens of their strings


@pytest.mark.parametrize("most", [3, 1000])
def test_ids_of_words_are_kept_for_later_texts(most):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        own = token_output.Tokens(f.read(), kept=most)
    asked, encode = [], own.chunks.encode
    own.chunks.encode = lambda chunks: asked.extend(chunks) or encode(chunks)
    words = [f"{a}{b}" for a in ("wor", "Ünï", "l1ne", "long" * 9) for b in ("d", "ed", "dly", "ß")]
    texts = [" ".join(["first", *words, *(f"{w}," for w in words)]), "first a.\nb word", *random_texts(200, 4)]
    again = []
    for part in (texts[:2], texts[:2], texts, texts[::-1]):
        asked.clear()
        ids, n = own.encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in part]
        kept = own.chunks.words.to_pylist()
        assert len(kept) == len(set(kept)) <= most and all(len(w.encode()) <= 32 for w in kept)
        again.append((sum(f" {w}" in asked for w in words[:12]), {"first", " a.", "b"} <= set(asked)))
    assert again[:2] == [(12, True), {3: (9, True), 1000: (0, False)}[most]]


def test_words_are_parted_from_marks_as_the_library_has_it():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        own, library = token_output.Tokens(f.read(), kept=9), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    asked, encode = [], own.chunks.encode
    own.chunks.encode = lambda chunks: asked.extend(chunks) or encode(chunks)
    marks = ["", ".", "&&&", ".%%%", "'", "''", "'s", "-", "(-)", "!?`", "\\", "_", "1.", "§", "]^", "'s.", "#a#"]
    text = "first" + "".join(f" {w}{m}" for w in ("word", "Über", "a", "isn't") for m in marks)
    ids, _ = own.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert {" word", ".%%%"} <= set(asked) and not {" word.", " word&&&", " word.%%%", " Über]^"} & set(asked)


def test_slices_have_about_one_size():
    def sizes(n, limit):
        return [len(x) for x in kept_chunks.even_slices(pa.RecordBatch.from_arrays([pa.array(["x"] * n, pa.string())], names=["text"]), 0, limit)]

    assert sizes(0, 10) == [] and sizes(1, 10) == [1] and sizes(168, 160) == [168]
    assert sizes(200, 160) == [100, 100] and sizes(1000, 160) == [143] * 6 + [142] and sizes(5, 1) == [1] * 5


def test_token_files_of_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    token_output.write(frame(spark, []), out, P.path("byte_bpe_50k.json"))
    assert token_output.read_index(spark, out).count() == 0
