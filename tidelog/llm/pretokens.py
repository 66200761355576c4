"""Encoding texts by way of the chunks between spaces, for tokenizers that split by the pattern of README's byte-level BPE.

Arrow cuts a batch of texts at spaces and numbers the distinct chunks; only these go to the tokenizer, and numpy lays the
chunks' ids side by side. No step is a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = r"\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space between two white-space characters, or between one and the end: there, and only there, a chunk's tokens
#: depend on its neighbours, for the pattern takes runs of white space together but for the last one before a word.
_TANGLED = rf"[{SPACES}] [{SPACES}]|[{SPACES}] \z"
#: Line feeds next to white space or an end; all others stand alone to the pattern, and chunks are cut there too.
_JOINED = rf"\A\n|\n\z|[{SPACES}]\n|\n[{SPACES}]"
#: A word of Latin letters and a mark, which the pattern parts before the mark.
_MARKED = r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[,.;:!?]\z"
#: Bytes of text that are encoded at once: enough for most of a text's chunks to come again, at about ten times that in memory.
SLICE = 24 << 20


def gathered(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The pieces of flat at the given starts, with the given lengths, side by side."""
    to = np.cumsum(n, dtype=np.int64)
    total = int(to[-1]) if len(to) else 0
    size = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((start - to + n).astype(size), n)
    at += np.arange(total, dtype=size)
    return flat.take(at)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // max(1, limit)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield batch.slice(a, b - a)


class Chunks:
    """ids(texts): all texts' ids side by side, and how many each has.

    encode takes strings that the pattern splits on their own and gives the same of them. Texts that hold one of `apart`
    go to it whole. Each distinct chunk of the texts is encoded once; nothing is kept, for looking up rare chunks in a store
    of Python strings takes as long as encoding them again.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], apart: tuple[str, ...] = ()):
        self.encode, self.apart = encode, apart

    def _entries(self, chunks: list[str], lined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each chunk's are. Chunks that are lined are cut at line feeds."""
        simple = list(compress(chunks, ~lined)) if lined.any() else chunks
        place: dict[str, int] = {}
        parts, counts = [], []
        for chunk in compress(chunks, lined):
            head, *rest = chunk.split("\n")
            parts.append(place.setdefault(head, len(place)))
            for line in rest:
                parts += (place.setdefault("\n", len(place)), place.setdefault(line, len(place)))
            counts.append(1 + 2 * len(rest))
        flat, n = self.encode([*simple, *place])
        start = np.cumsum(n) - n
        if not parts:
            return flat, start, n
        part, size = len(simple) + np.array(parts), np.array(counts)
        more, size = gathered(flat, start[part], n[part]), np.add.reduceat(n[part], np.cumsum(size) - size)
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[~lined], sizes[~lined] = start[: len(simple)], n[: len(simple)]
        starts[lined], sizes[lined] = len(flat) + np.cumsum(size) - size, size
        return np.concatenate([flat, more]), starts, sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        tangled = pc.match_substring_regex(texts, _TANGLED)
        for x in self.apart:
            tangled = pc.or_(tangled, pc.match_substring(texts, x))
        whole = tangled.to_numpy(zero_copy_only=False)
        words = pc.split_pattern(texts.filter(pa.array(~whole)) if whole.any() else texts, " ")
        counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
        first = np.cumsum(counts) - counts  # a text's first chunk has no space before it
        coded = words.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
        lined = pc.match_substring(coded.dictionary, "\n")
        alone = ~pc.match_substring_regex(coded.dictionary.filter(lined), _JOINED).to_numpy(zero_copy_only=False)
        lined = lined.to_numpy(zero_copy_only=False).copy()
        lined[lined] = alone
        inside = np.ones(len(code), bool)
        inside[first] = False
        used = np.flatnonzero(np.bincount(code[inside], minlength=len(names)))
        of_first, first_code = np.unique(code[first], return_inverse=True)
        # A word with a mark is mostly there without it too.
        every = coded.dictionary.take(pa.array(used))
        mark = pc.match_substring_regex(every, _MARKED)
        marked = mark.to_numpy(zero_copy_only=False)
        plain, both = every.filter(pc.invert(mark)), every.filter(mark)
        heads = pc.utf8_slice_codeunits(both, 0, -1)
        more = pc.unique(heads.filter(pc.is_null(pc.index_in(heads, value_set=plain))))
        plain = pa.concat_arrays([plain, more])
        marks = ",.;:!?"
        head = pc.index_in(heads, value_set=plain).to_numpy(zero_copy_only=False).astype(np.int64)
        tail = pc.index_in(pc.utf8_slice_codeunits(both, -1), value_set=pa.array(list(marks))).to_numpy(zero_copy_only=False).astype(np.int64)
        simple, firsts = plain.to_numpy(zero_copy_only=False).tolist(), names[of_first].tolist()
        has_line = np.concatenate([lined[used[~marked]], np.zeros(len(more), bool), lined[of_first], np.zeros(len(marks), bool)])
        flat, start, n = self._entries([f" {x}" for x in simple] + firsts + list(marks), has_line)
        pair = np.stack([head, len(simple) + len(firsts) + tail], 1).ravel()
        joined = n[pair].reshape(-1, 2).sum(1)
        flat, base = np.concatenate([flat, gathered(flat, start[pair], n[pair])]), len(flat)
        starts, sizes = (np.zeros(len(used) + len(firsts), np.int64) for _ in range(2))
        own = np.concatenate([~marked, np.ones(len(firsts), bool)])
        take = np.concatenate([np.arange(len(used) - len(both)), len(simple) + np.arange(len(firsts))])
        starts[own], sizes[own] = start[take], n[take]
        starts[~own], sizes[~own] = base + np.cumsum(joined) - joined, joined
        start, n = starts, sizes
        place = np.zeros(len(names), np.int32)
        place[used] = np.arange(len(used))
        at = place[code]
        at[first] = len(used) + first_code
        start, n = start.astype(np.int32 if len(flat) < 1 << 31 else np.int64), n.astype(np.int32)
        if not whole.any():
            return gathered(flat, start[at], n[at]), np.add.reduceat(n[at], first, dtype=np.int64)
        more, size = self.encode(texts.filter(pa.array(whole)).to_pylist())
        start = np.concatenate([start[at], len(flat) + np.cumsum(size) - size])
        n, flat = np.concatenate([n[at], size]), np.concatenate([flat, more])
        # Back in the order of the texts; one that went whole is one chunk.
        begin, many = np.zeros(len(whole), np.int64), np.ones(len(whole), np.int64)
        begin[~whole], many[~whole], begin[whole] = first, counts, len(at) + np.arange(len(size))
        order = gathered(np.arange(len(n)), begin, many)
        return gathered(flat, start[order], n[order]), np.add.reduceat(n[order], np.cumsum(many) - many, dtype=np.int64)
