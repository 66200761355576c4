"""As pretokens, with a store: chunks that came before aren't encoded again, and words are parted from runs of marks.

Only the token files use it; packing stays with pretokens, for with this its executors took more memory than they have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidelog.llm.pretokens import _JOINED, _TANGLED, gathered

#: A word of Latin letters and marks, which the pattern parts before the marks.
_MARKED = r"\A(?P<head>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<marks>[!-/:-@\[-`{-~]+)\z"
#: Bytes of the longest chunks that are kept between slices.
_SHORT = 32


def even_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, or one longer text; all of about one size, none a small rest."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = max(1, int(sizes.sum()))
    count = max(1, -((limit // 8 - total) // max(1, limit)))
    part = (np.cumsum(sizes) - sizes) * count // total
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)][: len(starts)], strict=True):
        yield batch.slice(a, b - a)


class KeptChunks:
    """ids(texts): all texts' ids side by side, and how many each has.

    encode takes strings that the pattern splits on their own and gives the same of them. Texts that hold one of `apart`
    go to it whole. Each distinct chunk of the texts is encoded once. The ids of the first `most` short ones are
    kept for later texts, as Arrow and numpy arrays: looking up rare chunks in a store of Python strings takes as long as
    encoding them again. Arrow hashes the store for each lookup, so texts of few chunks go without it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], apart: tuple[str, ...] = (), most: int = 0):
        self.encode, self.apart, self.most = encode, apart, most
        self.words, self.kept = pa.array([], pa.string()), (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _known(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each of the distinct chunks' are."""
        looked_up, (kept, begin, size) = 8 * len(chunks) >= len(self.words), self.kept
        at = pc.index_in(chunks, value_set=self.words) if looked_up else pa.nulls(len(chunks), pa.int32())
        new = pc.is_null(at)
        fresh, new, at = chunks.filter(new), new.to_numpy(zero_copy_only=False), at.drop_null().to_numpy()
        flat, n = self.encode(fresh.to_numpy(zero_copy_only=False).tolist())
        start = np.cumsum(n) - n
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[new], sizes[new], starts[~new], sizes[~new] = start, n, len(flat) + begin[at], size[at]
        if looked_up and len(self.words) < self.most:
            short = pc.less_equal(pc.binary_length(fresh), _SHORT).to_numpy(zero_copy_only=False)
            taken = np.flatnonzero(short)[: self.most - len(self.words)]
            more, own = gathered(flat, start[taken], n[taken]), n[taken]
            self.words = pa.concat_arrays([self.words, fresh.take(pa.array(taken))])
            self.kept = np.concatenate([kept, more]), np.concatenate([begin, len(kept) + np.cumsum(own) - own]), np.concatenate([size, own])
        return np.concatenate([flat, kept]), starts, sizes

    def _entries(self, chunks: pa.Array, lined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each chunk's are. Chunks that are lined are cut at line feeds."""
        lines = pc.split_pattern(chunks.filter(pa.array(lined)), "\n")
        every = pa.concat_arrays([chunks.filter(pa.array(~lined)), lines.flatten(), pa.array(["\n"])]).dictionary_encode()
        flat, start, n = self._known(every.dictionary)
        code, count = every.indices.to_numpy(), int((~lined).sum())
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[~lined], sizes[~lined] = start[code[:count]], n[code[:count]]
        if not lined.any():
            return flat, starts, sizes
        # Each line but a chunk's first comes after a line feed.
        per = np.diff(lines.offsets.to_numpy()).astype(np.int64)
        part = np.full(2 * int(per.sum()) - len(per), code[-1])
        first = np.cumsum(2 * per - 1) - (2 * per - 1)
        part[np.repeat(first, per) + 2 * (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per))] = code[count:-1]
        size = np.add.reduceat(n[part], first)
        starts[lined], sizes[lined] = len(flat) + np.cumsum(size) - size, size
        return np.concatenate([flat, gathered(flat, start[part], n[part])]), starts, sizes

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
        code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        lined = pc.match_substring(names, "\n")
        alone = ~pc.match_substring_regex(names.filter(lined), _JOINED).to_numpy(zero_copy_only=False)
        lined = lined.to_numpy(zero_copy_only=False).copy()
        lined[lined] = alone
        used = np.flatnonzero(np.bincount(code, minlength=len(names)) - np.bincount(code[first], minlength=len(names)))
        of_first, first_code = np.unique(code[first], return_inverse=True)
        # A word with marks is mostly there without them too.
        every = names.take(pa.array(used))
        mark = pc.match_substring_regex(every, _MARKED)
        marked = mark.to_numpy(zero_copy_only=False)
        plain, both = every.filter(pc.invert(mark)), every.filter(mark)
        parts = pc.extract_regex(both, _MARKED)
        heads, tails = parts.field("head"), parts.field("marks").dictionary_encode()
        more = pc.unique(heads.filter(pc.is_null(pc.index_in(heads, value_set=plain))))
        plain = pa.concat_arrays([plain, more])
        marks, tail = tails.dictionary, tails.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        head = pc.index_in(heads, value_set=plain).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = names.take(pa.array(of_first))
        has_line = np.concatenate([lined[used[~marked]], np.zeros(len(more), bool), lined[of_first], np.zeros(len(marks), bool)])
        spaced = pc.binary_join_element_wise(pa.scalar(" "), plain, "")
        flat, start, n = self._entries(pa.concat_arrays([spaced, firsts, marks]), has_line)
        pair = np.stack([head, len(plain) + len(firsts) + tail], 1).ravel()
        joined = n[pair].reshape(-1, 2).sum(1)
        flat, base = np.concatenate([flat, gathered(flat, start[pair], n[pair])]), len(flat)
        starts, sizes = (np.zeros(len(used) + len(firsts), np.int64) for _ in range(2))
        own = np.concatenate([~marked, np.ones(len(firsts), bool)])
        take = np.concatenate([np.arange(len(used) - len(both)), len(plain) + np.arange(len(firsts))])
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
