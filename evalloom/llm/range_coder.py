"""Context-mixing range coder for token ids, many blocks side by side.

A block of ids is coded on its own, from fresh statistics, so blocks decode independently and numpy can code the same place of
all blocks of a segment in one step. In each block
* order 2 and order 1 predict an id each: the one that followed the last two ids (the last id) before, with a confidence from
  how often it did;
* weights, one set for each pair of confidences and adapted after every id, mix these predictions with order 0;
* order 0 predicts every id: an adaptive distribution over 16 frequency classes, which learns every id, even within a class.
  Ids are ranked by their counts in the segment first, and a class is a power of two of ranks.
The mixed probabilities drive a range coder with 48 bits of range and 16-bit digits; carries are added when a block is done.

Segment layout, little-endian: b"CMRC", version u16, block length u16, ids u64, distinct ids u32, length u32 of the rank table,
number of blocks u32; the rank table (ids by falling count, u16, zlib); for each block: ids u32, digits u32, crc32 u32 (of
the block's ids as u16); the digits of all blocks (u16). Ids are below 65535.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"CMRC", 2
HEAD = struct.Struct("<4sHHQIII")
BLOCK, LANES = 2048, 3072
_BITS, _RATE = 10, 5
_CLASSES, _LEAST = 16, 35
_ORDER0 = 14  # bits of the class distribution
_MIX = 15  # bits of the mixing weights
_WHOLE = (1 << _MIX) - 1
_FLOOR = 128
_SPAN = (1 << _MIX) - 3 * _FLOOR
#: Upper ends of the classes after each class has been seen for ever, and at the start.
_TARGET = np.array([[(j + 1) * _LEAST if j < s else (1 << _ORDER0) - (_CLASSES - 1 - j) * _LEAST for j in range(_CLASSES)] for s in range(_CLASSES)], np.int16)
_START = np.array([(j + 1) * (1 << _ORDER0) // _CLASSES for j in range(_CLASSES)], np.int16)
_TRUST = np.array([300, 8000, 20000, 28000], np.int32)
_LOW32 = (1 << 32) - 1
_BASE = (1 << np.arange(_CLASSES + 1)).astype(np.int64)
_CLASS = (np.frexp(np.arange(65537, dtype=np.float64))[1] - 1).astype(np.int64)  # bit length - 1


class Model:
    """Statistics of ``n`` blocks. Symbols are ranks + 1; 0 stands before the first."""

    def __init__(self, n: int):
        self.n = n
        lanes = np.arange(n)
        self.at = lanes << _BITS
        self.at_weight = lanes << 4
        self.one_before = np.zeros(n << _BITS, np.int32)  # of the last symbol: follower << 2 | confidence
        self.two_before = np.zeros(n << _BITS, np.int32)
        two, one = np.repeat(_TRUST, 4), np.tile(_TRUST, 4)
        self.weights = np.tile((two << 16) | ((_WHOLE - two) * one >> _MIX), n)  # of order 2 and of order 1
        self.classes = np.tile(_START, (n, 1))
        self.last = np.zeros(n, np.uint32)
        self.before = np.zeros(n, np.uint32)

    def shrink(self, n: int) -> None:
        """Go on with the first ``n`` blocks; the others are at their ends."""
        self.n = n
        self.at, self.at_weight, self.last, self.before, self.classes = self.at[:n], self.at_weight[:n], self.last[:n], self.before[:n], self.classes[:n]

    def predict(self) -> None:
        """The predictions of both orders, and how much of 2**15 each gets."""
        h1 = self.last * np.uint32(0x9E3779B1)
        h2 = (h1 ^ (h1 >> np.uint32(15))) + self.before * np.uint32(0x85EBCA6B)
        self.slot1 = self.at + (h1 >> np.uint32(32 - _BITS))
        self.slot2 = self.at + (h2 >> np.uint32(32 - _BITS))
        entry1, entry2 = self.one_before.take(self.slot1), self.two_before.take(self.slot2)
        self.guess1, self.guess2 = entry1 >> 2, entry2 >> 2
        entry1 &= 3
        entry2 &= 3
        self.sure1, self.sure2 = entry1, entry2
        self.slot_w = self.at_weight + ((entry2 << 2) | entry1)
        w = self.weights.take(self.slot_w)
        self.w2, self.w1 = w >> 16, w & 0xFFFF
        self.f2 = ((self.w2 * _SPAN) >> _MIX) + _FLOOR
        self.both = ((self.w1 * _SPAN) >> _MIX) + self.f2 + _FLOOR

    def learn(self, x: np.ndarray, hit2: np.ndarray, also1: np.ndarray, hit1: np.ndarray) -> None:
        """``also1``: order 1 was right; ``hit1``: it was and order 2 was not."""
        entry = (x << 2) + 1
        self.two_before[self.slot2] = entry + hit2 * np.minimum(self.sure2, 2)
        self.one_before[self.slot1] = entry + also1 * np.minimum(self.sure1, 2)
        w2 = self.w2 + ((hit2 * np.int32(_WHOLE) - self.w2) >> _RATE)
        w1 = self.w1 + ((hit1 * np.int32(_WHOLE) - self.w1) >> _RATE)
        self.weights[self.slot_w] = (w2 << 16) | w1
        self.before, self.last = self.last, x.astype(np.uint32)

    def interval(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of class c of each block."""
        line = self.at_weight + c  # a block has as many weights as classes
        flat = self.classes.ravel()
        end = flat.take(line).astype(np.int64)
        line -= 1
        start = flat.take(line, mode="clip") * (c > 0)
        return start, end - start

    def learn_classes(self, c: np.ndarray) -> None:
        step = _TARGET.take(c, axis=0)
        step -= self.classes
        step >>= _RATE
        self.classes += step


def encode_blocks(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits (block, place) and their numbers, of ``x`` [place, block]; ``lengths`` do not rise."""
    steps, n = x.shape
    m = Model(n)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64)
    room = 9 * steps // 4 + 16  # a symbol takes 33 bits at most
    out = np.zeros((n, room), np.int32)
    flat, place = out.ravel(), np.arange(n) * room
    live = n
    for t in range(steps):
        while live and lengths[live - 1] <= t:
            live -= 1
        if live < m.n:
            m.shrink(live)
        lo, sp, at = low[:live], span[:live], place[:live]
        s = x[t, :live]
        m.predict()
        hit2 = m.guess2 == s
        also1 = m.guess1 == s
        hit1 = also1 > hit2
        start = np.where(hit2, 0, np.where(hit1, m.f2, m.both))
        size = np.where(hit2, m.f2, np.where(hit1, m.both, 1 << _MIX)) - start
        sp >>= _MIX
        lo += sp * start
        sp *= size
        # order 0, for all blocks at once; those with a hit leave their ranges as they are
        miss = ~(hit2 | also1)
        c = _CLASS.take(s)
        a, b = m.interval(c)
        r = sp >> _ORDER0
        a = r * a
        r *= b
        r >>= c
        a += r * (s - _BASE.take(c))
        a *= miss
        lo += a
        np.copyto(sp, r, where=miss)
        m.learn_classes(c)
        # one digit of every block is written; it stays where the range has become small
        short = sp <= 1 << 32
        flat[at] = lo >> 32
        at += short
        np.copyto(lo, (lo & _LOW32) << 16, where=short)
        np.copyto(sp, sp << 16, where=short)
        while len(k := np.flatnonzero(sp <= 1 << 32)):
            v = lo[k]
            flat[at[k]] = v >> 32
            at[k] += 1
            lo[k] = (v & _LOW32) << 16
            sp[k] <<= 16
        m.learn(s, hit2, also1, hit1)
    for _ in range(3):
        flat[place] = low >> 32
        low = (low & _LOW32) << 16
        place += 1
    while (over := out >> 16).any():  # carries
        out &= 0xFFFF
        out[:, :-1] += over[:, 1:]
    return out, place - np.arange(n) * room


def decode_blocks(digits: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols [place, block] of the blocks whose digits begin at ``starts``; ``lengths`` do not rise."""
    n, steps = len(lengths), int(lengths.max(initial=0))
    m = Model(n)
    x = np.zeros((steps, n), np.int32)
    digits = np.concatenate([digits.astype(np.int64), np.zeros(8, np.int64)])  # a damaged block may ask for more: clipped
    place = starts.astype(np.int64)
    code = (digits[place] << 32) | (digits[place + 1] << 16) | digits[place + 2]
    place = place + 3
    span = np.full(n, 1 << 48, np.int64)
    live = n
    for t in range(steps):
        while live and lengths[live - 1] <= t:
            live -= 1
        if live < m.n:
            m.shrink(live)
        co, sp, at = code[:live], span[:live], place[:live]
        m.predict()
        sp >>= _MIX
        # quotients of such integers are exact when rounded down: they stay below 2**16, their products below 2**49
        v = (co / sp).astype(np.int32)
        hit2 = v < m.f2
        hit1 = (v < m.both) > hit2
        miss = v >= m.both
        start = np.where(hit2, 0, np.where(hit1, m.f2, m.both))
        size = np.where(hit2, m.f2, np.where(hit1, m.both, 1 << _MIX)) - start
        co -= sp * start
        sp *= size
        s = np.where(hit2, m.guess2, m.guess1)
        # order 0, for all blocks at once; those with a hit keep what they have
        r = sp >> _ORDER0
        v = np.minimum(co / r, (1 << _ORDER0) - 1).astype(np.int16)
        below = (m.classes <= v[:, None]).view(np.uint64)  # 16 bytes of 0 or 1 a row; a product adds up eight
        c = (((below[:, 0] + below[:, 1]) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)
        a, b = m.interval(c)
        c0 = co - r * a
        r *= b
        r >>= c
        first = _BASE.take(c)
        off = np.minimum(c0 / r, first - 1).astype(np.int32)
        c0 -= r * off
        np.copyto(co, c0, where=miss)
        np.copyto(sp, r, where=miss)
        np.copyto(s, first + off, where=miss, casting="same_kind")
        m.learn_classes(np.where(miss, c, _CLASS.take(s)))
        short = sp <= 1 << 32
        np.copyto(co, (co << 16) | digits.take(at, mode="clip"), where=short)
        np.copyto(sp, sp << 16, where=short)
        at += short
        while len(k := np.flatnonzero(sp <= 1 << 32)):
            co[k] = (co[k] << 16) | digits.take(at[k], mode="clip")
            at[k] += 1
            sp[k] <<= 16
        x[t, :live] = s
        m.learn(s, hit2, m.guess1 == s, hit1)
    return x


def encode_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment of the ids (u16)."""
    ids = np.ascontiguousarray(ids, "<u2")
    counts = np.bincount(ids, minlength=1)
    order = np.lexsort((np.arange(len(counts)), -counts))[: int((counts > 0).sum())]
    rank = np.zeros(len(counts), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    n = -(-len(ids) // block)
    table = zlib.compress(order.astype("<u2").tobytes(), 6)
    head = HEAD.pack(MAGIC, VERSION, block, len(ids), len(order), len(table), n)
    if not n:
        return head + table
    padded = np.zeros(n * block, np.int32)
    padded[: len(ids)] = rank[ids]
    lengths = np.full(n, block, np.int64)
    lengths[-1] = len(ids) - (n - 1) * block
    out, used = encode_blocks(np.ascontiguousarray(padded.reshape(n, block).T)[: int(lengths.max())], lengths)
    keep = np.arange(out.shape[1])[None] < used[:, None]
    sums = [zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) for i in range(n)]
    blocks = np.column_stack([lengths, used, sums]).astype("<u4").tobytes()
    return head + table + blocks + out[keep].astype("<u2").tobytes()


def decode_segment(data: bytes | memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the segment at ``at`` and where it ends. A damaged block raises ValueError."""
    magic, version, block, total, distinct, size, n = HEAD.unpack_from(data, at)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"no segment at byte {at}")
    at += HEAD.size
    order = np.frombuffer(zlib.decompress(data[at : at + size]), "<u2")
    at += size
    blocks = np.frombuffer(data, "<u4", 3 * n, at).reshape(n, 3).astype(np.int64)
    at += 12 * n
    digits = np.frombuffer(data, "<u2", int(blocks[:, 1].sum()), at)
    at += 2 * len(digits)
    if not n:
        return np.zeros(0, np.uint16), at
    if len(order) != distinct or blocks[:, 0].sum() != total:
        raise ValueError("damaged segment header")
    symbols = decode_blocks(digits, np.cumsum(blocks[:, 1]) - blocks[:, 1], blocks[:, 0])
    table = np.concatenate([[0], order]).astype("<u2")
    whole = table.take(np.minimum(symbols, distinct)).T.copy()
    parts = []
    for i, (length, _, crc) in enumerate(blocks.tolist()):
        own = whole[i, :length]
        if zlib.crc32(own.tobytes()) != crc:
            raise ValueError(f"block {i} does not match its checksum")
        parts.append(own)
    return np.concatenate(parts), at
