"""An adaptive context-mixing range coder for token ids.

A frame's ids are cut into blocks of at most BLOCK ids. Each block starts from the same state and carries a CRC-32 of its ids, so
it can be decoded, checked and lost on its own, given the frame's head. All blocks of a frame are coded side by side:
each numpy operation does one step of every block.

The head has the state that blocks are reset to: the frame's ids with their frequencies, and the id that most often
follows each of them. There are three predictions for each id: the id that last followed the two ids before it in its block
(order 2), the one that most often follows the id before it (order 1), and the frequencies (order 0). The chance that
order 2 is right is mixed in the logistic domain from the adaptive chances of orders 2 and 1, with weights that learn from
the errors; where order 2 fails, order 1 has an adaptive chance of its own, by how sure the head says it is. An id is
one interval: that of order 2, that of order 1, or its share by frequency of what these leave. All arithmetic is on integers,
so any machine decodes what another one wrote.

Ids are unsigned 32-bit integers; others are refused with a ValueError, as are a damaged head or block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
MAGIC = b"TLT2"
_HEAD = struct.Struct("<4sQIIBII")
_SLOTS = 9  # bits of a block's table of order 2
_TOP, _KEEP, _ALL = 46, (1 << 46) - 1, (1 << 62) - 1  # a word of 16 bits leaves the state's 62 at the top

#: Logistic tables in integers: stretch of p / 4096 in 1/256, and its inverse.
_STRETCH = np.array([round(256 * float(np.log((p + 0.5) / (4095.5 - p)))) for p in range(4096)], np.int32)
_STRETCH = np.concatenate([_STRETCH, -_STRETCH >> 2])  # the second half is for order 1 where it has another id than order 2
_SQUASH = np.array([min(3968, max(4, int(4096 / (1 + 2.718281828459045 ** (-x / 256))))) for x in range(-2304, 2305)], np.int32)
#: What adaptive chances move to, in 1/65536; they never reach it, so that every interval keeps a width.
_YES, _NO, _RATE = 64000, 500, 5
_GAIN, _LEAST, _FULL, _LIMIT = np.array([_YES - _NO, _NO, 4095, 200000], np.int32)
#: How sure order 1 is: shares of the most frequent follower, and the chances that each class starts from.
_SHARES = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
_FIRST2 = np.array([1000, 16000, 32000, 45000], np.int32)
_FIRST1 = np.array([700, 2000, 4500, 9000, 17000, 27000, 40000, 56000], np.int32)


class _Start:
    """What a frame's blocks start from. Symbols are places of ids in the sorted list of the frame's ids."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, follower: np.ndarray, sure: np.ndarray, bits: int):
        self.ids, self.freq, self.follower, self.sure, self.bits = ids, freq, follower, sure, bits
        self.cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.int64)

    @classmethod
    def of(cls, symbols: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> _Start:
        n, bits = len(ids), max(16, (4 * len(ids) - 1).bit_length())
        freq = 1 + counts * ((1 << bits) - n) // max(1, len(symbols))
        freq[np.argmax(freq)] += (1 << bits) - freq.sum()
        pairs = symbols[:-1].astype(np.uint32 if n <= 65536 else np.uint64)
        pairs *= n
        pairs += symbols[1:].astype(pairs.dtype)
        pairs, times = np.unique(pairs, return_counts=True)
        before, after = pairs // n, pairs % n
        follower, sure = np.zeros(n, np.int64), np.zeros(n, np.uint8)
        if len(pairs):
            starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
            sizes = np.diff(np.append(starts, len(pairs)))
            most, total = np.maximum.reduceat(times, starts), np.add.reduceat(times, starts)
            best = np.flatnonzero(times == np.repeat(most, sizes))[::-1]
            follower[before[best]] = after[best]  # the smallest of equally frequent ones
            sure[before[starts]] = np.searchsorted(_SHARES, most / total, "right")
        return cls(ids, freq, follower, sure, bits)

    def packed(self) -> bytes:
        gaps = np.diff(self.ids, prepend=0)
        return zlib.compress(b"".join(x.astype("<u4").tobytes() for x in (gaps, self.freq, self.follower)) + self.sure.tobytes())

    @classmethod
    def unpacked(cls, data: bytes, bits: int) -> _Start:
        data = zlib.decompress(data)
        n = len(data) // 13
        gaps, freq, follower = np.frombuffer(data, "<u4", 3 * n).astype(np.int64).reshape(3, n)
        return cls(np.cumsum(gaps), freq, follower, np.frombuffer(data, np.uint8, n, 12 * n), bits)


class _Model:
    """Tables of all blocks of a frame, one row each, flat. Indices are of the platform's own index type, which numpy needs no copy for."""

    def __init__(self, lanes: int, start: _Start):
        self.first = (start.follower << 3 | start.sure).astype(np.int64)  # order 1: the follower, and how sure it is
        self.base, self.row2, self.row1 = (np.arange(lanes, dtype=np.intp) * n for n in (1 << _SLOTS, 4, 8))
        self.seen = np.zeros(lanes << _SLOTS, np.int32)  # order 2: the symbol, and how often it held, up to 3
        self.p2, self.p1 = np.tile(_FIRST2, lanes), np.tile(_FIRST1, lanes)
        self.w2, self.w1 = np.full(lanes, 40000, np.int32), np.full(lanes, 26000, np.int32)
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the intervals of orders 2 and 1, in 1/65536."""
        last = self.last
        at = self.before * 30011
        at ^= last * 40503
        at >>= 3
        at &= (1 << _SLOTS) - 1
        at += self.base
        self.at = at
        cell, one = self.seen.take(at, mode="clip").astype(np.int64), self.first.take(last, mode="clip")
        self.c2, self.n2, self.c1 = cell >> 2, cell & 3, one >> 3
        self.k2, self.k1 = self.n2 + self.row2, (one & 7) + self.row1
        self.q2, self.q1 = self.p2.take(self.k2, mode="clip"), self.p1.take(self.k1, mode="clip")
        other = (self.c2 != self.c1).astype(np.int32)
        self.s2, self.s1 = _STRETCH.take(self.q2 >> 4, mode="clip"), _STRETCH.take(self.q1 >> 4 | other << 12, mode="clip")
        mixed = self.w2 * self.s2
        mixed += self.w1 * self.s1
        mixed >>= 16
        mixed += 2304
        self.pa = _SQUASH.take(mixed, mode="clip")
        a = self.pa << 4
        b = (65536 - a).view(np.uint32)  # times a chance, it is below 2 ** 32
        b *= self.q1.view(np.uint32)
        b >>= 16
        b *= other.view(np.uint32)
        b += a.view(np.uint32)
        return a.astype(np.int64), b.astype(np.int64)

    def update(self, now, hit2, hit1) -> None:
        hits = hit2.astype(np.int32)
        error = hits * _FULL
        error -= self.pa
        for w, s in ((self.w2, self.s2), (self.w1, self.s1)):
            s *= error
            s >>= 9
            w += s
            np.minimum(w, _LIMIT, out=w)
            np.maximum(w, -_LIMIT, out=w)
        for p, k, q, hit in ((self.p2, self.k2, self.q2, hits), (self.p1, self.k1, self.q1, hit1.astype(np.int32))):
            hit *= _GAIN
            hit += _LEAST
            hit -= q
            hit >>= _RATE
            hit += q
            p[k] = hit
        held = self.n2
        held += 1
        np.minimum(held, 3, out=held)
        held *= hit2.astype(np.int64)
        held |= now << 2
        self.seen[self.at] = held.astype(np.int32)
        self.before, self.last = self.last, now


def _interval(start: _Start, now, a, b, hit2, hit1):
    """Start and width of each block's id, in 1 / 2 ** (16 + bits)."""
    bits = start.bits
    wide = 65536 - b
    low, width = start.cum.take(now, mode="clip"), start.freq.take(now, mode="clip")
    low *= wide
    low += b << bits
    width *= wide
    end = a << bits
    first = hit1 > hit2
    np.copyto(low, end, where=first)
    np.copyto(width, (b - a) << bits, where=first)
    np.copyto(low, 0, where=hit2)
    np.copyto(width, end, where=hit2)
    return low, width


def _turned(array: np.ndarray) -> np.ndarray:
    """The array's transpose, copied by 64 rows at once: lines of cache that rows of a power of two share would be lost before they are full."""
    out = np.empty(array.shape[::-1], array.dtype)
    for i in range(0, len(array), 64):
        out[:, i : i + 64] = array[i : i + 64].T
    return out


def _laid(symbols: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    lanes = max(1, -(-len(symbols) // block))
    out = np.zeros(lanes * block, symbols.dtype)
    out[: len(symbols)] = symbols
    sizes = np.full(lanes, block)
    sizes[-1] = len(symbols) - (lanes - 1) * block
    return _turned(out.reshape(lanes, block)), sizes


def encode(ids: np.ndarray, block: int | None = None) -> bytes:
    """A frame: magic, counts, the start of its blocks, each block's length and checksum, then the blocks.

    A small frame has smaller blocks, for its steps should serve many blocks each.
    """
    ids = np.asarray(ids)
    block = block or min(BLOCK, max(128, len(ids) >> 11))
    if len(ids) > 1 << 28:
        raise ValueError("a frame has at most 2 ** 28 ids")
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids must be unsigned 32-bit integers")
    if len(ids) and ids.max() < 1 << 20:
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        place, counts = np.zeros(known[-1] + 1, np.int32), counts[known]
        place[known] = np.arange(len(known))
        symbols = place[ids]
    else:
        known, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
    start = _Start.of(symbols, known.astype(np.int64), counts) if len(ids) else _Start(*(np.zeros(1, np.int64) for _ in range(4)), 16)
    laid, sizes = _laid(symbols, block)
    lanes, width, total = len(sizes), int(sizes.max()), 16 + start.bits
    model = _Model(lanes, start)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _ALL, np.int64)
    words, n = np.zeros((3 * width + 4, lanes), np.int32), np.zeros(lanes, np.int64)
    flat = words.ravel()
    for t in range(width):
        now = laid[t].astype(np.int64)
        a, b = model.predict()
        hit2, hit1 = model.c2 == now, model.c1 == now
        begin, freq = _interval(start, now, a, b, hit2, hit1)
        if t >= sizes[-1]:  # the last block has ended: the whole interval says nothing
            begin[-1], freq[-1] = 0, 1 << total
        r = span >> total
        begin *= r
        low += begin
        span = r * freq
        over = np.flatnonzero(low > _ALL)
        if len(over):
            flat[(n[over] - 1) * lanes + over] += 1  # carries are settled at the end
            low[over] &= _ALL
        small = np.flatnonzero(span <= _KEEP)
        while len(small):
            own = low[small]
            flat[n[small] * lanes + small] = own >> _TOP
            n[small] += 1
            low[small] = (own & _KEEP) << 16
            narrow = span[small] << 16
            span[small] = narrow
            small = small[narrow <= _KEEP]
        model.update(now, hit2, hit1)
    # One more word places the state within the last interval; the words after it count as zero.
    low += _KEEP
    over = np.flatnonzero(low > _ALL)
    flat[(n[over] - 1) * lanes + over] += 1
    flat[n * lanes + np.arange(lanes)] = (low & _ALL) >> _TOP
    n += 1
    carry = np.zeros(lanes, np.int32)
    for t in range(int(n.max()) - 1, -1, -1):
        words[t] += carry
        carry = words[t] >> 16
        words[t] &= 0xFFFF
    plain = ids.astype("<u4")
    sums = [zlib.crc32(plain[i * block : (i + 1) * block].tobytes()) for i in range(lanes)]
    body, head = words[: int(n.max())].T.astype("<u2"), start.packed()
    front = _HEAD.pack(MAGIC, len(ids), block, lanes, start.bits, len(head), zlib.crc32(head))
    return front + head + n.astype("<u4").tobytes() + np.array(sums, "<u4").tobytes() + b"".join(body[i, : n[i]].tobytes() for i in range(lanes))


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; ValueError if the head's or a block's checksum fails."""
    magic, total, block, lanes, bits, size, crc = _HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    head = frame[_HEAD.size : _HEAD.size + size]
    if zlib.crc32(head) != crc:
        raise ValueError("the head is damaged")
    start, at = _Start.unpacked(head, bits), _HEAD.size + size
    n = np.frombuffer(frame, "<u4", lanes, at).astype(np.int64)
    sums = np.frombuffer(frame, "<u4", lanes, at + 4 * lanes)
    laid = np.zeros((lanes, int(n.max()) + 5), np.uint16)
    laid[np.arange(laid.shape[1]) < n[:, None]] = np.frombuffer(frame, "<u2", int(n.sum()), at + 8 * lanes)
    data, place = laid.ravel(), np.arange(lanes) * laid.shape[1]
    last = total - (lanes - 1) * block
    width, wide = (block if lanes > 1 else last), 16 + bits
    out = np.zeros((width, lanes), np.uint32)
    model, inverse = _Model(lanes, start), np.repeat(np.arange(len(start.freq)), start.freq)
    code, span = np.zeros(lanes, np.int64), np.full(lanes, _ALL, np.int64)
    code += data[place].astype(np.int64) << 46
    for shift in (30, 14, -2):
        place = place + 1
        word = data[place].astype(np.int64)
        code += word << shift if shift > 0 else word >> -shift
    rest = word & 3  # two bits of the fourth word are not in the state yet
    place = place + 1
    for t in range(width):
        a, b = model.predict()
        r = span >> wide
        value = (code.view(np.uint64) // r.view(np.uint64)).view(np.int64)
        np.minimum(value, (1 << wide) - 1, out=value)
        kind = value >> bits
        hit2 = kind < a
        first = (kind < b) & ~hit2
        value -= b << bits
        np.maximum(value, 0, out=value)
        now = inverse.take((value / (65536 - b)).astype(np.int64), mode="clip")
        now = np.where(hit2, model.c2, np.where(first, model.c1, now))
        if ended := t >= last:
            now[-1] = 0
        hit2, hit1 = model.c2 == now, model.c1 == now
        begin, freq = _interval(start, now, a, b, hit2, hit1)
        if ended:
            begin[-1], freq[-1] = 0, 1 << wide
        begin *= r
        code -= begin
        span = r * freq
        small = np.flatnonzero(span <= _KEEP)
        while len(small):
            at = place[small]
            word = rest[small] << 16
            word |= data.take(at, mode="clip").astype(np.int64)
            code[small] = code[small] << 16 | word >> 2
            rest[small] = word & 3
            place[small] = at + 1
            narrow = span[small] << 16
            span[small] = narrow
            small = small[narrow <= _KEEP]
        model.update(now, hit2, hit1)
        out[t] = start.ids.take(now, mode="clip")
    out = _turned(out)
    for i in range(lanes):
        if zlib.crc32(out[i, : block if i < lanes - 1 else last].astype("<u4").tobytes()) != sums[i]:
            raise ValueError(f"block {i} is damaged")
    return out.reshape(-1)[:total]
