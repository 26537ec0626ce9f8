"""Alignments of long sequences: edit distances in words of bits, and matching blocks by a suffix automaton.

Both are exact. The edit distance keeps a band of a column of the table as the bits of two numbers, so a step handles a whole
column at once, and widens the band until the distance fits: for pages that differ in a few per cent of 100,000 characters it
costs a small part of the full table. Matching blocks (longest common block, then left and right of it) find each block in time
linear in what is left, where comparing all equal pairs is quadratic.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Hashable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import ship

#: First half-width of the band.
BAND = 64


def edit_distance(a: str, b: str) -> int:
    """Fewest insertions, deletions and substitutions of characters that turn one text into the other."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return max(len(a), len(b)) - high
    while low < high:  # common beginning and end cost nothing
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle :] == b[len(b) - middle :] else (low, middle - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return len(a) + len(b)
    most, width = max(len(a), len(b)), max(BAND, abs(len(a) - len(b)))
    while True:
        found = _in_band(a, b, width)
        if found <= width or width >= most:
            return found
        width = min(most, 2 * width)


def _in_band(a: str, b: str, width: int) -> int:
    """Cost of the cheapest alignment that stays within ``width`` of the diagonal.

    Rows are characters of ``a``, columns those of ``b``. ``up`` and ``down`` say where a column grows or falls by one from a
    row to the next; only rows from ``first`` on, ``rows`` of them, are kept, and ``score`` is the value in the last of them.
    Beyond the band values are taken to grow by one, which is never below the truth.
    """
    places: dict[str, int] = defaultdict(int)
    by_char: dict[str, list[int]] = defaultdict(list)
    for i, c in enumerate(a):
        by_char[c].append(i)
    for c, at in by_char.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        places[c] = int.from_bytes(bits, "little")
    first, rows = 0, min(len(a), width)
    up, down, score = (1 << rows) - 1, 0, rows
    for j, c in enumerate(b):
        if first + rows < len(a):
            up |= 1 << rows
            rows += 1
            score += 1
        if first < j - width:
            up, down = up >> 1, down >> 1
            first += 1
            rows -= 1
        full = (1 << rows) - 1
        same = (places.get(c, 0) >> first) & full
        equal = (((same & up) + up) ^ up) | same | down
        equal &= full
        right = down | (full & ~(equal | up))
        left = equal & up
        score += (right >> (rows - 1) & 1) - (left >> (rows - 1) & 1)
        right = (right << 1 | 1) & full
        up = (left << 1 & full) | (full & ~(equal | right))
        down = right & equal
    return score


def with_error_rates(rows: DataFrame, hypothesis: str, reference: str, name: str = "cer") -> DataFrame:
    """Add the character error rate: edit distance over the reference's length; both empty 0, one empty 1; null is empty."""
    ship(rows.sparkSession)

    @F.pandas_udf("double")
    def rated(h, r):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([0.0 if not a and not b else 1.0 if not a or not b else edit_distance(a, b) / len(b) for a, b in zip(h.fillna(""), r.fillna(""), strict=True)], dtype="float64")

    return rows.withColumn(name, rated(F.col(hypothesis), F.col(reference)))


class _Automaton:
    """All blocks of a sequence, each with the end of its first occurrence."""

    def __init__(self, items: Sequence[Hashable]):
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for k, x in enumerate(items):
            new = self._state({}, 0, self.size[last] + 1, k)
            at = last
            while at >= 0 and x not in self.next[at]:
                self.next[at][x] = new
                at = self.link[at]
            if at >= 0:
                there = self.next[at][x]
                if self.size[there] > self.size[at] + 1:
                    copy = self._state(dict(self.next[there]), self.link[there], self.size[at] + 1, self.end[there])
                    while at >= 0 and self.next[at].get(x) == there:
                        self.next[at][x] = copy
                        at = self.link[at]
                    self.link[there] = there = copy
                self.link[new] = there
            last = new

    def _state(self, following: dict[Hashable, int], link: int, size: int, end: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1


def matching_size(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Total length of the matching blocks of two sequences, by their published definition.

    The longest block that both have (of equal ones the first in ``a``, then in ``b``), grown by equal neighbours, then the same
    on either side of it. In sequences ``b`` of 200 items or more, those that make up over one per cent of it start no block.
    """
    counts = Counter(b)
    popular = {x for x, n in counts.items() if len(b) >= 200 and n > len(b) // 100 + 1}
    where: dict[Hashable, list[int]] = defaultdict(list)
    for j, y in enumerate(b):
        if y not in popular:
            where[y].append(j)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, n = _longest(a, a0, a1, b, b0, b1, where)
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return total


def _longest(a: Sequence, a0: int, a1: int, b: Sequence, b0: int, b1: int, where: dict[Hashable, list[int]]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest block of items that may start one."""
    if a0 >= a1 or b0 >= b1:
        return a0, b0, 0
    spans, pairs = [], 0
    for x in a[a0:a1]:
        at = where.get(x, ())
        span = (bisect_left(at, b0), bisect_left(at, b1)) if at else (0, 0)
        spans.append(span)
        pairs += span[1] - span[0]
    best = (a0, b0, 0)
    if pairs <= 8 * (a1 - a0 + b1 - b0):  # few equal pairs: follow each
        ends: dict[int, int] = {}
        for i, (x, (low, high)) in enumerate(zip(a[a0:a1], spans), a0):
            now: dict[int, int] = {}
            for j in where[x][low:high] if high > low else ():
                now[j] = n = ends.get(j - 1, 0) + 1
                if n > best[2]:
                    best = (i - n + 1, j - n + 1, n)
            ends = now
        return best
    own = _Automaton([y if y in where else (None, j) for j, y in enumerate(b[b0:b1])])
    state = n = 0
    for i, x in enumerate(a[a0:a1], a0):
        if x not in where:
            state = n = 0
            continue
        while state and x not in own.next[state]:
            state = own.link[state]
            n = own.size[state]
        if x in own.next[state]:
            state = own.next[state][x]
            n += 1
        if n > best[2]:
            best = (i - n + 1, b0 + own.end[state] - n + 1, n)
    return best


def block_similarity(pred: Sequence[Hashable], ref: Sequence[Hashable]) -> float:
    """Dice of the matching blocks: both empty 1, one empty 0."""
    if not pred and not ref:
        return 1.0
    if not pred or not ref:
        return 0.0
    return round(2.0 * matching_size(pred, ref) / (len(pred) + len(ref)), 4)
