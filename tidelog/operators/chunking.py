"""Content-defined chunks, compressibility, transforms of blocks: the byte-level steps, in Arrow batches."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Our own bounds and rule: a chunk ends where the top bits of a gear hash of the last 32 bytes are zero.
LEAST, AVERAGE_BITS, MOST = 256, 10, 4096


def _gear() -> np.ndarray:
    """256 words from SHA-256 of their numbers: a rule, not a table."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


_GEAR = _gear()


def cut_points(data: bytes, least: int = LEAST, bits: int = AVERAGE_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    words = _GEAR[np.frombuffer(data, np.uint8)]
    hashes = np.zeros(n, np.uint32)
    for shift in range(32):  # the byte `shift` places back weighs 2^shift, so only the last 32 count
        if shift >= n:
            break
        hashes[shift:] += words[: n - shift] << np.uint32(shift)
    marks = np.flatnonzero(hashes >> np.uint32(32 - bits) == 0) + 1
    out, start = [], 0
    while n - start > least:
        i = np.searchsorted(marks, start + least)
        end = int(marks[i]) if i < len(marks) else n
        start = min(end, start + most, n)
        out.append(start)
        if start == n:
            return out
    return out + ([n] if start < n else [])


def _chunked(least, bits, most):
    def run(batches):
        for batch in batches:
            out = {"path": [], "part": [], "chunk": [], "sha1": []}
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                for part, end in enumerate(cut_points(data or b"", least, bits, most)):
                    piece = data[start:end]
                    for name, value in zip(out, (path, part, piece, hashlib.sha1(piece).hexdigest()), strict=True):
                        out[name].append(value)
                    start = end
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("chunk", pa.binary()), ("sha1", pa.string())]))

    return run


def content_chunks(docs: DataFrame, least: int = LEAST, bits: int = AVERAGE_BITS, most: int = MOST, content: str = "content", key: str = "path") -> DataFrame:
    """path, part, chunk, sha1: an edit changes few chunks, so unchanged ones are found again."""
    return docs.select(F.col(key).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(_chunked(least, bits, most), "path string, part long, chunk binary, sha1 string")


def compressed_sizes(docs: DataFrame, level: int = 6, content: str = "content", key: str = "path") -> DataFrame:
    """path, bytes, packed: what deflate makes of each file."""

    def run(batches):
        for batch in batches:
            data = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([len(zlib.compress(x, level)) for x in data], pa.int64())], names=["path", "bytes", "packed"])

    return docs.select(F.col(key).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, bytes long, packed long")


def bwt(data: bytes) -> tuple[bytes, int]:
    """Burrows-Wheeler transform with an end mark: last column without the mark, and the mark's place. Prefix doubling, n log^2 n."""
    n = len(data) + 1
    rank = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1, [0]])
    k = 1
    while True:
        second = np.concatenate([rank[k:], np.full(min(k, n), -1)])[:n]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    mark = int(rank[0])
    column = np.frombuffer(data + b"\0", np.uint8)[order - 1]
    return np.delete(column, mark).tobytes(), mark


def unbwt(column: bytes, mark: int) -> bytes:
    n = len(column) + 1
    last = np.concatenate([np.frombuffer(column[:mark], np.uint8).astype(np.int64) + 1, [0], np.frombuffer(column[mark:], np.uint8).astype(np.int64) + 1])
    before = np.empty(n, np.int64)
    before[np.argsort(last, kind="stable")] = np.arange(n)
    out, row = bytearray(), 0
    for _ in range(n - 1):
        out.append(last[row] - 1)
        row = before[row]
    return bytes(reversed(out))


def sparse_runs(data: bytes, page: int = 4096) -> list[tuple[int, int]]:
    """Runs (offset, length) of whole pages that are not all zero; the last page always counts."""
    out: list[tuple[int, int]] = []
    for at in range(0, len(data), page):
        piece = data[at : at + page]
        if piece.count(0) == len(piece) and at + page < len(data):
            continue
        if out and sum(out[-1]) == at:
            out[-1] = (out[-1][0], out[-1][1] + len(piece))
        else:
            out.append((at, len(piece)))
    return out


def e8e9(data: bytes, back: bool = False) -> bytes:
    """The filter for x86 code: after a call or jump (E8, E9) whose address' last byte is 0 or 255, the lower three bytes,
    a relative address, get the place added (or taken off again). Done from the end on, back from the start on.
    """
    out, n = bytearray(data), len(data)
    places = range(n - 4) if back else range(n - 5, -1, -1)
    for i in places:
        if out[i] & 254 == 0xE8 and (out[i + 4] + 1) & 254 == 0:
            address = int.from_bytes(out[i + 1 : i + 4], "little") + (-i if back else i)
            out[i + 1 : i + 4] = (address & 0xFFFFFF).to_bytes(3, "little")
    return bytes(out)
