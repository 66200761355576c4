"""Variable-capacity best-fit packing of token ids.

Documents become ids with an end id behind each, and pieces of at most the largest permitted length; pieces go to bins,
each of which is one training sequence. Several lengths are permitted and chosen jointly: for the largest piece that is
left, each length that holds it is tried with what it can still be filled with, by best fit from the histogram of all pieces
that are left (the largest that fits, again and again). The length whose bin costs least for each id in it is opened; of
lengths that cost the same, the largest, so that room stays open as long as it is free. In the end each bin is downsized to
the smallest permitted length that holds its contents, which is also what a try is charged. A sequence costs OVERHEAD,
its length, and a share that grows with the square of its length: short sequences waste the first, long ones the last, and
room wastes the second.

Bins of one content are opened at once, as often as the histogram allows, so the work grows with the distinct sizes.

Pieces are dealt to groups of about GROUP bytes of text by a hash, with their ids: one shuffle. A group is packed on its
own, so no task sees more than one at a time, whatever the number of rows; no key of the documents decides the group, so
neither copies nor a repeated or missing doc_id fill one. A row's hash holds its task and its number among equal rows
there, so that a task that runs again deals as before.

Defined results: null text counts as empty (one end id); rows that repeat a doc_id are documents of their own; a null
doc_id is packed like any other; an empty table gives an empty result; columns besides doc_id and text are ignored; which
of equally long pieces share a bin depends on how the rows are partitioned, and so may the cost, slightly.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, tidy
from tidelog.llm.pretokens import slices
from tidelog.llm.token_output import END_ID, made

LENGTHS = (1024, 2048, 4096, 8192)
GROUP = 4 << 20
#: What a sequence costs beside its length, and the length at which the quadratic part equals the linear one.
OVERHEAD, SQUARE = 64, 32768
#: Bytes of text that are tokenised at once.
SLICE = 16 << 20
_BIN = pa.schema(
    [("bin_id", pa.int64()), ("bin_length", pa.int64()), ("opened_length", pa.int64()), ("n_tokens", pa.int64())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "pieces", "places", "lengths")]
    + [("ids", pa.list_(pa.int32()))]
)
_BIN_SQL = "bin_id long, bin_length long, opened_length long, n_tokens long, " + ", ".join(
    f"{n} array<long>" for n in ("doc_ids", "pieces", "places", "lengths")
) + ", ids array<int>"
_PIECE_SQL = "doc_id long, piece long, place_in long, grp long, width int, ids binary"
_WIDTHS = {2: "<u2", 4: "<u4"}


def cost(length: int, overhead: int = OVERHEAD, square: int = SQUARE) -> float:
    return overhead + length * (1 + length / square)


def _filled(some: int, left: dict[int, int], first: int, length: int) -> dict[int, int]:
    """Sizes and how many of each a bin gets that has the size `first` and, by best fit, the largest that fit after it."""
    got, room = {first: 1}, length - first
    some &= (1 << room + 1) - 1
    while some:
        size = some.bit_length() - 1
        spare = left[size] - got.get(size, 0)
        n = min(spare, room // size)
        if n:
            got[size] = got.get(size, 0) + n
            room -= n * size
        some &= (1 << min(size, room + 1)) - 1
    return got


def plan(sizes: Counter, lengths=LENGTHS, overhead: int = OVERHEAD, square: int = SQUARE) -> list[tuple[int, int, int, dict[int, int]]]:
    """Rows (times, final length, opened length, {size: how many}): the bins for all pieces of a histogram."""
    lengths, left = sorted(lengths), {s: n for s, n in sizes.items() if n}
    if left and not 0 < min(left) <= max(left) <= lengths[-1]:
        raise ValueError(f"a piece of {max(left)} or {min(left)} fits no permitted length")
    some = sum(1 << s for s in left)  # bit s: there are pieces of size s
    final = lambda used: next(n for n in lengths if n >= used)
    out = []
    while some:
        first, best = some.bit_length() - 1, None
        for length in lengths:
            if length >= first:
                got = _filled(some, left, first, length)
                used = sum(s * n for s, n in got.items())
                each = cost(final(used), overhead, square) / used
                if best is None or each <= best[0]:
                    best = each, length, final(used), got
        _, opened, length, got = best
        times = min(left[s] // n for s, n in got.items())
        for s, n in got.items():
            left[s] -= times * n
            if not left[s]:
                some ^= 1 << s
        out.append((times, length, opened, got))
    return out


def pack(sizes: list[int], lengths=LENGTHS, overhead: int = OVERHEAD, square: int = SQUARE):
    """Of each size: its bin and its place in the bin; and each bin's final and opened length."""
    order: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        order.setdefault(sizes[i], []).append(i)
    bins, places, final, opened = [0] * len(sizes), [0] * len(sizes), [], []
    for times, length, open_length, got in plan(Counter(sizes), lengths, overhead, square):
        for _ in range(times):
            at = 0
            for size in sorted(got, reverse=True):
                for _ in range(got[size]):
                    i = order[size].pop()
                    bins[i], places[i] = len(final), at
                    at += size
            final.append(length)
            opened.append(open_length)
    return bins, places, final, opened


def _cut(shared, end_id: int, most: int, groups: int, special_as_text: bool):
    """Pieces of documents with their ids and their group."""

    def run(batches):
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        tokens, task = made(shared.value, special_as_text), TaskContext.get().partitionId()
        width = 2 if max(len(tokens.spaced), end_id + 1) <= 65536 else 4
        seen: Counter = Counter()
        for batch in batches:
            for rows in slices(batch, 1, SLICE):
                ids, n = tokens.encode(rows.column(1))
                data = np.insert(ids.astype(_WIDTHS[width]), np.cumsum(n), end_id).tobytes()
                out, at = {k: [] for k in ("doc_id", "piece", "place_in", "grp", "width", "ids")}, 0
                for doc_id, tag, size in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), (n + 1).tolist(), strict=True):
                    seen[doc_id, tag] += 1
                    for piece in range(-(-size // most)):
                        length = min(most, size - piece * most)
                        key = xxh64_intdigest(f"{doc_id} {tag} {task} {seen[doc_id, tag]} {piece}")
                        for k, v in zip(out, (doc_id, piece, key >> 1, key % groups, width, data[at : at + width * length]), strict=True):
                            out[k].append(v)
                        at += width * length
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def _bins(lengths, overhead: int, square: int):
    def packed(group: int, width: int, rows: list[tuple]):
        sizes = [len(r[2]) // width for r in rows]
        bins, places, final, opened = pack(sizes, lengths, overhead, square)
        order = np.lexsort((places, bins))
        own = np.array(bins)[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        n = np.array(sizes)[order]
        used = np.add.reduceat(n, starts)
        ids = np.frombuffer(b"".join([rows[i][2] for i in order]), _WIDTHS[width]).astype(np.int32)
        ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        many = ends(np.diff(np.append(starts, len(n))))
        each = [[rows[i][0] for i in order], [rows[i][1] for i in order], [places[i] for i in order], n]
        lists = [pa.ListArray.from_arrays(many, pa.array(x, pa.int64())) for x in each]
        columns = [pa.array((group << 32) + np.arange(len(final))), pa.array(final, pa.int64()), pa.array(opened, pa.int64()), pa.array(used)]
        return pa.RecordBatch.from_arrays([*columns, *lists, pa.ListArray.from_arrays(ends(used), pa.array(ids))], schema=_BIN)

    def run(batches):
        now, held = (None, None), []
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                for doc_id, piece, *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != now and held:
                        yield packed(*now, held)
                        held = []
                    now = key
                    held.append((doc_id, piece, ids))
        if held:
            yield packed(*now, held)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    lengths=LENGTHS,
    group: int = GROUP,
    overhead: int = OVERHEAD,
    square: int = SQUARE,
    end_id: int = END_ID,
    special_as_text: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """A row for each bin: bin_id, bin_length, opened_length, n_tokens, the doc_ids, pieces, places and lengths of what it
    holds, and ids, the sequence itself (its n_tokens ids; what is left of bin_length is room).

    tokenizer: a tokenizers file; it is a few MB of fixed size and broadcast.
    """
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-total // group))
    cut = tidy(_cut(shared, end_id, max(lengths), groups, special_as_text))
    cut = rows.withColumn("tag", F.xxhash64("text")).mapInArrow(cut, _PIECE_SQL)
    dealt = cut.repartition("grp").sortWithinPartitions("grp", "place_in").select("doc_id", "piece", "grp", "width", "ids")
    return dealt.mapInArrow(tidy(_bins(tuple(lengths), overhead, square)), _BIN_SQL)


def _packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packed(docs)
