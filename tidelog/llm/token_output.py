"""Token-ID output: texts become ids, ids become frames of an adaptive context-mixing range coder, frames become files.

Documents are sorted by doc_id over range partitions; a partition is a shard. A shard's documents are tokenised in
order, and about FRAME ids (of whole documents) make a frame: see token_coder. A row of the Parquet files is a frame with
its place (shard, part) and its index of documents; Spark's committer writes them to any file system that Spark knows,
and a lost task writes its shard again. Reading checks every block's checksum and gives each document its ids' place.

Defined results: null text counts as empty; each document ends with the end id, so none is without ids; null doc_ids come
first; rows that repeat a doc_id are documents of their own, side by side; strings of special tokens in texts become
those tokens, as in the library's own defaults (a parameter makes them ordinary text); an empty table gives no frames and an empty result; a document of any length is in one frame (ids of a frame
must fit in a worker's memory: about 50 bytes for each); ids have up to 32 bits; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm import token_coder
from tidelog.llm.common import scratch, table, tidy
from tidelog.llm.kept_chunks import KeptChunks, even_slices
from tidelog.llm.pretokens import SLICE, SPACES, Chunks, gathered

FRAME = 1 << 22
END_ID = 2
#: Chunks whose ids a Python worker keeps, of about 40 bytes each.
KEPT = 1 << 19
#: How a byte-level vocabulary writes the space.
_SPACE = "\u0120"
#: A space and letters: one word to the usual pattern.
_ASCII = r"\A [A-Za-z]+\z"
_LATIN = r"\A [A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z"
_BARE = _LATIN.replace(r"\A ", r"\A")
#: A space and a word, which has no white space at its ends and no space within.
_WORD = rf"\A [^{SPACES}]([^ ]*[^{SPACES}])?\z"
FRAMES = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("frame", pa.binary())])
FRAMES_SQL = "shard int, part int, n_ids long, doc_ids array<long>, lengths array<long>, frame binary"


def _alphabet() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes (as Latin-1 characters), with line feeds left as they are."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)} | {10: "\n"}


class Tokens:
    """A tokenizers file; ids as the library gives them with add_special_tokens=False, as unsigned 32-bit integers.

    Strings of special tokens in texts become those tokens, as the library has it; special_as_text makes them ordinary text.
    Byte-level BPE by the usual pattern goes by way of distinct chunks; all other tokenizers get whole texts.
    """

    def __init__(self, content: bytes, special_as_text: bool = False, kept: int = 0):
        from tokenizers import Tokenizer

        self.tokenizer, about = Tokenizer.from_buffer(content), json.loads(content)
        self.tokenizer.encode_special_tokens = special_as_text
        split = about.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.by_chunks = usual and not any(about.get(x) for x in ("normalizer", "truncation", "padding"))
        if self.by_chunks:
            # The same model on words that are already written in its alphabet, one to a line.
            lines = {**about, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}
            self.by_line, self.alphabet = Tokenizer.from_str(json.dumps(lines)), _alphabet()
        #: Whether an id's bytes begin with a space.
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(_SPACE)]] = True
        apart = tuple(x["content"] for x in about.get("added_tokens") or [])
        self.chunks = KeptChunks(self._encode, apart, kept) if kept else Chunks(self._encode, apart)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of a space and a word go to the library side by side: only their first ids begin with a space."""
        left, rest, found, masks = np.arange(len(chunks)), chunks, [], []
        array = pa.array(chunks, pa.string())
        for pattern, encode in ((_ASCII, self._ascii), (_LATIN, self._latin), (_BARE, self._bare), (_WORD, self._joined), ("", self._apart)):
            fits = pc.match_substring_regex(array, pattern)
            mask = fits.to_numpy(zero_copy_only=False)
            own = list(compress(rest, mask))
            found.append((encode(own) or self._apart(own)) if own else (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
            masks.append(left[mask])
            left, rest, array = left[~mask], list(compress(rest, ~mask)), array.filter(pc.invert(fits))
        n, start, base = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), 0
        for mask, (ids, size) in zip(masks, found, strict=True):
            n[mask], start[mask] = size, base + np.cumsum(size) - size
            base += len(ids)
        return gathered(np.concatenate([ids for ids, _ in found]), start, n), n

    def _split(self, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray] | None:
        """None if the ids don't fall into as many chunks."""
        starts = np.flatnonzero(self.spaced[ids])
        return (ids, np.diff(np.append(starts, len(ids)))) if len(starts) == count and (not count or starts[0] == 0) else None

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        return self._split(self._apart(["".join(chunks[i : i + 500]) for i in range(0, len(chunks), 500)])[0], len(chunks))

    def _latin(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        texts = ["\n".join(chunks[i : i + 500]).encode().decode("latin-1").translate(self.alphabet) for i in range(0, len(chunks), 500)]
        return self._split(self._apart(texts, self.by_line)[0], len(chunks))

    def _bare(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As _latin(), of words without a space: each comes after a line of one space, whose id goes."""
        if not (found := self._latin([f" \n{x}" for x in chunks])):
            return None
        ids, n = found
        return np.delete(ids, np.cumsum(n) - n), n - 1

    def _ascii(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As _latin(); of these characters only the space is written differently in the alphabet."""
        texts = ["\n".join(chunks[i : i + 500]).replace(" ", _SPACE) for i in range(0, len(chunks), 500)]
        return self._split(self._apart(texts, self.by_line)[0], len(chunks))

    def _apart(self, texts: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.uint32)]
        for at in range(0, len(texts), 1000):
            got = (tokenizer or self.tokenizer).encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)
            found += [np.array(x.ids, np.uint32) for x in got]
        return np.concatenate(found), np.array([len(x) for x in found[1:]], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids side by side, and how many each text has."""
        return self.chunks.ids(texts) if self.by_chunks else self._apart([x or "" for x in texts.to_pylist()])


_MADE: dict[tuple[bytes, bool, int], Tokens] = {}


def made(content: bytes, special_as_text: bool = False, kept: int = 0) -> Tokens:
    """One for each Python worker: its store of chunks serves later tasks too. The cluster's cores are the tasks'."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(content).digest(), special_as_text, kept
    if key not in _MADE:
        _MADE[key] = Tokens(content, special_as_text, kept)
    return _MADE[key]


def _frames(shared, end_id: int, frame: int, special_as_text: bool):
    def run(batches):
        from pyspark import TaskContext

        tokens, shard, part = made(shared.value, special_as_text, KEPT), TaskContext.get().partitionId(), 0
        doc_ids, held, lengths, size = [], [], [], 0

        def row():
            values = [[shard], [part], [size], [doc_ids], [np.concatenate(lengths)], [token_coder.encode(np.concatenate(held))]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(values, FRAMES, strict=True)], schema=FRAMES)

        for batch in batches:
            for rows in even_slices(batch, 1, min(SLICE, 4 * frame)):
                ids, n = tokens.encode(rows.column(1))
                ids, own = np.insert(ids, np.cumsum(n), end_id), rows.column(0).to_pylist()
                ends = np.cumsum(n + 1)
                # A slice of more ids than a frame is cut at documents, into parts of about one size.
                cuts = np.unique(np.searchsorted(ends, np.linspace(0, ends[-1], max(1, round(len(ids) / frame)) + 1)[1:-1]))
                for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                    held.append(ids[ends[a - 1] if a else 0 : ends[b - 1] if b else 0])
                    lengths.append(n[a:b] + 1)
                    doc_ids += own[a:b]
                    size += len(held[-1])
                    if size >= frame or b < len(own) and size:
                        yield row()
                        doc_ids, held, lengths, size, part = [], [], [], 0, part + 1
        if held:
            yield row()

    return run


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    frame: int = FRAME,
    special_as_text: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
) -> None:
    """Writes docs' ids to path. tokenizer: a tokenizers file; it is a few MB of fixed size and broadcast."""
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Rows that share a doc_id (or have none) may fill several ranges: their number parts them.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    rows.mapInArrow(tidy(_frames(shared, end_id, frame, special_as_text)), FRAMES_SQL).write.parquet(path)


_READ = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches):
    for batch in batches:
        for shard, part, doc_ids, lengths, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = token_coder.decode(frame).astype("<u4", copy=False)
            ends = np.cumsum(lengths)
            at = ends - lengths
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, ends, strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(at, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], schema=_READ)


def _ids(batches):
    for batch in batches:
        for doc_ids, lengths, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = token_coder.decode(frame)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids, pa.int64()))], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every document in the files."""
    return spark.read.schema(FRAMES_SQL).parquet(path).select("doc_ids", "lengths", "frame").mapInArrow(_ids, "doc_id long, ids array<long>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its decoded ids.

    A frame's start is the sum of all shards before its own (one row for each shard) and of the parts before it.
    """
    files = spark.read.schema(FRAMES_SQL).parquet(path)
    parts = files.select("shard", "part", "n_ids")
    shards = parts.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    parts = parts.withColumn("within", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids"))
    starts = parts.join(shards, "shard").select("shard", "part", (F.col("before") + F.col("within")).alias("base"))
    found = files.select("shard", "part", "doc_ids", "lengths", "frame").mapInArrow(tidy(_documents), "shard int, part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(spark, path)
