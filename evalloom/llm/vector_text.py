"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than the six ASCII white-space bytes; A-Z count as a-z in hashes. No Python object is made
for a word or a shingle. Texts are taken whole, in slices of about ``SLICE`` bytes (a longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
MOST_TEXTS = 60_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Random odd multipliers that keep the words of a shingle apart by place.
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * SLICE:
            return made[0], made[1]  # for one very long text; not kept
        _powers = (made[0], made[1])
    return _powers


@dataclass
class Words:
    """The words of some texts: ``first[d]`` to ``first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWER[self.data].astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        size = (self.ends - self.starts).astype(np.uint64)
        return mix64((sums[self.ends] - sums[self.starts]) * down[self.starts] + size * np.uint64(0xC2B2AE3D27D4EB4F))


def slices(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(place of the first text, words of the texts) for runs of texts of about SLICE bytes; null texts are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1), at + MOST_TEXTS)
        own = offsets[at : end + 1] - offsets[at]
        yield at, _words(data[offsets[at] : offsets[end]], own)
        at = end


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    space = _IS_SPACE[data]
    inside = ~space
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    after[-1:] = True
    after[:-1] = space[1:]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    before[cuts] = True
    after[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


SET_BITS = 48


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first): the distinct shingles of each text, ascending, text ``d`` from first[d] to first[d + 1].

    A text with fewer words than ``size`` has its whole sequence as one shingle, one without words has none. Hashes have
    48 bits, so that one sort of 64-bit numbers, the text's place above the hash, orders all texts of a slice.
    """
    key, of = shingle_hashes(words, size)
    both = np.sort((of.astype(np.uint64) << np.uint64(SET_BITS)) | key)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    first = np.searchsorted(both, np.arange(len(words.counts) + 1, dtype=np.uint64) << np.uint64(SET_BITS))
    return both & np.uint64((1 << SET_BITS) - 1), first


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle, repeats included, in no order."""
    h = words.hashes()
    counts = words.counts
    n = max(len(h) - size + 1, 0)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key += h[k : k + n] * _PLACES[k]
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = doc[:n] == doc[size - 1 : size - 1 + n]
    key, of = key[whole], doc[:n][whole]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        lengths = counts[few]
        at = words.first[few]
        extra = lengths.astype(np.uint64)
        for k in range(size - 1):
            has = lengths > k
            extra[has] += h[at[has] + k] * _PLACES[k]
        key, of = np.concatenate([key, extra]), np.concatenate([of, few])
    return mix64(key) >> np.uint64(64 - SET_BITS), of
