"""Byte-level BPE by a sentencepiece model that is serialised directly from a vocabulary of ranks.

Each byte stands for one character from U+0100 on, each token for the string of its bytes' characters, and its score is
its rank below zero: sentencepiece joins the pair with the best score, leftmost first, as byte-level BPE joins the pair
of least rank. The normaliser is the identity. The model's message is written here field by field, so nothing is trained.
A pre-token that is itself in the vocabulary is that token, as in the usual implementation; all others go to the model.
Decoding maps ids to their bytes.

Defined results: null text counts as empty (no ids); the vocabulary must have every single byte; rows that repeat a
doc_id are rows of their own; an empty table gives an empty result; columns besides doc_id and text are ignored. The
vocabulary (a few MB, of fixed size) is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, tidy
from tidelog.llm.pretokens import Chunks, gathered, slices

_OFFSET = 0x100
_MAP = {b: chr(_OFFSET + b) for b in range(256)}
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2
#: Bytes of text that are encoded and decoded at once; their bytes are laid side by side too, so it is less than elsewhere.
_SLICE = 6 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _integer(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAP)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces in order of rank, <unk> last."""
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out += _message(1, _message(1, mapped(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _integer(3, _NORMAL))
    out += _message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _integer(3, _UNKNOWN))
    trainer = _integer(3, _BPE) + _integer(4, len(ranks) + 1) + _integer(40, len(ranks))
    normaliser = _message(1, b"identity") + _integer(3, 0) + _integer(4, 0) + _integer(5, 0)
    return bytes(out + _message(2, trainer) + _message(3, normaliser))


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must run from 0 without gaps and include all single bytes")
        # The class of white space that the pattern's usual engine has, which leaves out U+001C to U+001F.
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.ranks = ranks
        tokens = sorted(ranks, key=ranks.get)
        self.bytes, self.sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pieces: dict[str, bytes] = {}
        self.chunks = Chunks(self._encode)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        splits = [self.split(c) for c in chunks]
        if len(self.pieces) > 200_000:
            self.pieces = {}
        pieces, new = self.pieces, []
        for p in {p for s in splits for p in s}:
            if p not in pieces:
                data = p.encode()
                whole = self.ranks.get(data)
                if whole is None:
                    new.append((p, mapped(data)))
                else:
                    pieces[p] = struct.pack("<I", whole)
        if new:
            for (p, _), ids in zip(new, self.model.encode([m for _, m in new], out_type=int, num_threads=1), strict=True):
                pieces[p] = np.array(ids, "<u4").tobytes()
        found = [b"".join([pieces[p] for p in s]) for s in splits]
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids side by side, and how many each has."""
        return self.chunks.ids(texts)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def decode_batch(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of each text: ids side by side, n of each."""
        data, size = gathered(self.bytes, self.starts[ids], self.sizes[ids]).tobytes(), self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))].tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids) -> bytes:
        return self.decode_batch(np.array(ids, np.int64), np.array([len(ids)]))[0]


_MADE: dict[tuple[bytes, str], ByteBPE] = {}


def _made(ranks: dict[bytes, int], digest: bytes, pattern: str) -> ByteBPE:
    """One for each Python worker: its store of chunks serves later tasks too."""
    if (digest, pattern) not in _MADE:
        _MADE[digest, pattern] = ByteBPE(ranks, pattern)
    return _MADE[digest, pattern]


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _tokenised(shared, digest: bytes, pattern: str):
    def run(batches):
        bpe, sha = _made(shared.value, digest, pattern), hashlib.sha256
        for batch in batches:
            for rows in slices(batch, 1, _SLICE):
                ids, n = bpe.encode_batch(rows.column(1))
                data, ends = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(n) * 4)).tolist()
                of_ids = [sha(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                of_bytes = [sha(x).hexdigest() for x in bpe.decode_batch(ids, n)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(of_ids), pa.array(of_bytes)], schema=_DIGESTS)

    return run


def _encoded(shared, digest: bytes, pattern: str):
    def run(batches):
        bpe = _made(shared.value, digest, pattern)
        for batch in batches:
            for rows in slices(batch, 1, _SLICE):
                ids, n = bpe.encode_batch(rows.column(1))
                ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return run


def _mapped_docs(docs: DataFrame, make, path: str, pattern: str, schema: str, text: str, doc_id: str) -> DataFrame:
    ranks = read_ranks(path)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).digest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(make(shared, digest, pattern)), schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids: each text's token ids."""
    return _mapped_docs(docs, _encoded, path, pattern, "doc_id long, ids array<int>", text, doc_id)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the ids, decoded_sha256 of the bytes that the ids decode to."""
    return _mapped_docs(docs, _tokenised, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", text, doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
