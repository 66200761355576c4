"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits variants of itself within half the radius; fingerprints that share a variant are
candidates, and those that truly differ in at most three bits are linked.

Half of the radius three is one bit on one side and two on the other. All fingerprints emit themselves and their 64
one-bit variants, so pairs that differ in one or two bits meet. Of two fingerprints that differ in three bits, one has
an even number of set bits. Two of the three bits lie in one half of the word; with both flipped, the even one is a
one-bit variant of the odd one. So only even fingerprints emit two-bit variants, and only within a half: 992, not 2016.

At one variant, sources within one bit of it differ in two bits at most, and those two bits away differ from these in
three at most. All are therefore linked to one source within one bit of it, after a check of the distance. That keeps
every component whole without emitting the pairs of a group: links grow as the variants do, never with a group's square.
Two sources that are both two bits away and meet no nearer one differ in two or four bits; those with two meet at a
one-bit variant.

Defined results: null and wordless texts have fingerprint zero, linked like any other; rows that repeat a doc_id are
rows of their own; a null doc_id is no component's smallest unless all are null; an empty table gives an empty result;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import discard, free_shuffles, keep_rows, table, tidy, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Flipped bits of each variant: none, one, or two in one half of the word (these only for fingerprints of even parity).
_ONE = [1 << i for i in range(64)]
_TWO = [1 << i | 1 << j for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
MASKS = np.array([0, *_ONE, *_TWO], np.uint64)
NEAR = 65
#: An odd factor deals variants over the buckets by their product's top bits; its inverse undoes it.
_MIX = 0x9E3779B97F4A7C15
_UNMIX = pow(_MIX, -1, 1 << 64)
#: Fingerprints whose variants are built at once, variants that a bucket should hold, bits that a shuffle deals by, and
#: variants that are dealt on at once.
_BATCH, _BUCKET_ROWS, _LEVEL, _GATHER = 2048, 1 << 20, 12, 1 << 22


def shingle_hashes(data: bytes, n: int = SHINGLE) -> list[int]:
    """XXH64 of each run of n words of a lower-cased text, repeats included; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not words:
        return []
    if len(words) <= n:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    if n == 3:
        return [xxh64_intdigest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    return [xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def _weighed(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > totals[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprints(n: int, chunk: int = 1 << 16):
    def flush(lists):
        """Fingerprints of the texts whose hashes are given; those of a long text are summed in chunks."""
        out = np.zeros(len(lists), np.uint64)
        full = [i for i, x in enumerate(lists) if x]
        small = [i for i in full if len(lists[i]) <= chunk]
        if small:
            sizes = np.array([len(lists[i]) for i in small])
            hashes = np.array([h for i in small for h in lists[i]], np.uint64)
            out[small] = _weighed(_bit_counts(hashes, np.concatenate(([0], np.cumsum(sizes)[:-1]))), sizes)
        for i in full:
            if (size := len(lists[i])) > chunk:
                parts = [_bit_counts(np.array(lists[i][k : k + chunk], np.uint64), np.array([0])) for k in range(0, size, chunk)]
                out[i] = _weighed(np.sum(parts, axis=0), np.array([size]))[0]
        return out.view(np.int64)

    def run(batches):
        for batch in batches:
            lists, held, done = [], 0, []
            for text in batch.column(1):
                lists.append(x := shingle_hashes(text.as_buffer().to_pybytes(), n) if text.is_valid else [])
                held += len(x)
                if held > chunk:
                    done.append(flush(lists))
                    lists, held = [], 0
            done.append(flush(lists))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(done))], names=["doc_id", "tag", "fp"])

    return run


def fingerprints(docs: DataFrame, n: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, tag (hash of the text as it is), fp: the fingerprint as a signed long."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("tag")).mapInArrow(tidy(_fingerprints(n)), "doc_id long, tag long, fp long")


_BLOBS = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("variants", pa.binary())])
_BLOBS_SQL = "bucket int, n long, variants binary"


def _blobs(mixed: np.ndarray, code: np.ndarray, bits: int) -> pa.RecordBatch:
    """Variants in blobs, one for each bucket (the first bits of a variant) that has any, sorted, with each one's number of its mask."""
    order = np.argsort(mixed)
    mixed, code = mixed[order], code[order]
    bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(mixed))
    # Byte planes, largest first: sorted values have runs there, which Spark's compression removes.
    packed = [mixed[a:b].astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() + code[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(ends - starts), pa.array(packed, pa.binary())], schema=_BLOBS)


def _unpacked(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(blob, np.uint8)
    return np.ascontiguousarray(data[: 8 * n].reshape(8, n).T).view(">u8").ravel().astype(np.uint64), data[8 * n :].view(np.uint16)


def _variants(bits: int):
    def run(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), _BATCH):
                fps = every[at : at + _BATCH]
                even = fps[np.bitwise_count(fps) % 2 == 0]
                mixed = np.concatenate([(fps[:, None] ^ MASKS[:NEAR]).ravel(), (even[:, None] ^ MASKS[NEAR:]).ravel()]) * np.uint64(_MIX)
                near, far = np.arange(NEAR, dtype=np.uint16), np.arange(NEAR, len(MASKS), dtype=np.uint16)
                yield _blobs(mixed, np.concatenate([np.tile(near, len(fps)), np.tile(far, len(even))]), bits)

    return run


def _finer(bits: int, gather: int):
    """Blobs that have met are cut by more bits, many of them at once, so that a blob stays far larger than its row's cost."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(_unpacked(n, blob))
                size += n
                if size >= gather:
                    yield _blobs(np.concatenate([m for m, _ in held]), np.concatenate([c for _, c in held]), bits)
                    held, size = [], 0
        if held:
            yield _blobs(np.concatenate([m for m, _ in held]), np.concatenate([c for _, c in held]), bits)

    return run


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node that each can reach."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _links(mixed: np.ndarray, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of the sources that share a variant, reduced to one path to the smallest node of each component."""
    order = np.argsort(mixed, kind="stable")
    mixed, code = mixed[order], code[order]
    shared = np.zeros(len(mixed), bool)
    same = mixed[1:] == mixed[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    mixed, code = mixed[shared], code[shared]
    if not len(mixed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    source = (mixed * np.uint64(_UNMIX) ^ MASKS[code]).view(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], mixed[1:] != mixed[:-1])))
    top = np.iinfo(np.int64).max
    near = np.minimum.reduceat(np.where(code < NEAR, source, top), starts)
    # A run without a source within one bit gives no link; its centre would be `top`, which the distance check refuses
    # unless a source is near it, and then the link is a true one.
    centre = np.repeat(near, np.diff(np.append(starts, len(mixed))))
    linked = (source != centre) & (np.bitwise_count(source.view(np.uint64) ^ centre.view(np.uint64)) <= radius) & (centre != top)
    a, b = source[linked], centre[linked]
    if not len(a):
        return a, b
    nodes, root = _roots(a, b)
    far = nodes != root
    return nodes[far], root[far]


def _meet(radius: int):
    def out(held):
        mixed, code = zip(*held, strict=True)
        a, b = _links(np.concatenate(mixed), np.concatenate(code), radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now and held:
                    yield out(held)
                    held = []
                now = bucket
                held.append(_unpacked(n, blob))
        if held:
            yield out(held)

    return run


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs, a <> b -> (a, b): every node but the smallest of its component, with that smallest one.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing changes. Each is a partial aggregation
    and an equi-join whose hot keys adaptive execution splits; each step's links are a table in the shared folder.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        new = written(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        discard(now)
        now, before, seen = new, seen, state(new)
        if seen == before:
            break
    return now


def link(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = _BUCKET_ROWS, level: int = _LEVEL, gather: int = _GATHER) -> DataFrame:
    """(a, b): a path of links between all fingerprints of prints (fp) that chains of distance <= radius connect.

    There are as many buckets as keep each near bucket_rows variants. A batch is dealt to at most 2 ** level of them, and where
    there are more, what met is dealt on by the next bits: blobs grow in number as the fingerprints do, not as their square.
    """
    if not 0 <= radius <= 3:
        raise ValueError("variants are built for a radius of at most 3")
    spark = prints.sparkSession
    n = prints.count()
    bits = max(6, int(np.ceil(np.log2(max(1, n * 561 / bucket_rows)))))
    dealt = min(bits, level)
    sent = prints.select("fp").mapInArrow(tidy(_variants(dealt)), _BLOBS_SQL).repartitionById(1 << dealt, "bucket")
    while dealt < bits:
        dealt = min(bits, dealt + level)
        sent = sent.mapInArrow(tidy(_finer(dealt, gather)), _BLOBS_SQL).repartitionById(1 << min(dealt, 16), "bucket")
    met = sent.sortWithinPartitions("bucket").mapInArrow(tidy(_meet(radius)), "a long, b long")
    out = written(met, "met")
    free_shuffles(spark)
    return out


def _members(docs: DataFrame, radius: int, n: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Tables: doc_id, tag, fp of each row of docs; fp and stay: the smallest doc_id of its component and the smallest tag with it."""
    rows = written(fingerprints(docs, n, text, doc_id), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")), "prints")
    met = link(prints, radius)
    path = components(met)
    discard(met)
    member = prints.join(path, prints.fp == path.a, "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("stay"))
    mapped = written(member.join(least, "root").select("fp", "stay"), "members")
    discard(path)
    discard(prints)
    return rows, mapped


def near_dedup(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    rows, mapped = _members(docs, radius, n, text, doc_id)
    return rows.join(mapped, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("stay.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component: of its smallest doc_id (null only if it has no other); of that one's texts, an
    arbitrary but repeatable one, and one of the rows that repeat it. A doc_id's other texts go with their own components."""
    kept = F.expr("doc_id <=> stay.doc_id AND tag = stay.tag")
    rows, mapped = _members(docs, radius, n, text, doc_id)
    verdicts = written(rows.join(mapped, "fp").select("doc_id", "tag", kept.alias("kept")), "verdicts")
    discard(rows)
    discard(mapped)
    return keep_rows(docs, verdicts, F.xxhash64(text), True, doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
