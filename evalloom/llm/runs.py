"""Periodic runs of words: maximal repetitions of every text, found by the runs theorem, and the text with them collapsed.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), long enough, that no
neighbouring word extends. Every run holds a Lyndon root: under one of the two opposite orders of the alphabet its first root
is the longest Lyndon word at its place. So candidates are few and found without comparing stretches:

1. suffix array of the words of a text by prefix doubling; only suffixes that still tie are sorted again;
2. the longest Lyndon word at i ends at the next smaller value of the inverse suffix array; under the opposite order, at the
   next greater one;
3. the root [i, j) is extended to the right by lcp(i, j), and to the left by the largest k for which lcp(i - k, j - k) still
   reaches the same end; both are minima over ranges of the LCP array, answered by a sparse table over blocks.

Texts are independent, so Spark deals them out; a task works through its Arrow batches in slices of about ``SLICE`` bytes, the
arrays of a slice are concatenated and all steps run over all its texts at once. Time is n log n in the words of a text at
the worst, also for texts of one repeated word and for falling sequences of words.

Defined results: a null, empty or blank text has no words, no runs and the collapsed text ''. Words are compared exactly (no
case folding, no hashing). Repeated rows and ids are documents apart. Other columns stay; a column named like a result is
replaced. An empty table gives an empty result. A very long text is held whole by its task: some 100 bytes a word, up to
4 more a word and level of doubling where the text itself repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalloom.session import ship

SLICE = 1 << 21
BLOCK = 32
#: Rounds of pointer jumping before the few texts that need more of them are finished with a stack.
JUMPS = 48
RUN = "struct<start:long,length:long,period:long>"
FOUND = f"n_words long, runs array<{RUN}>, top_run {RUN}, collapsed string"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, first): the words of text d are those from first[d] to first[d + 1]."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)  # white space at either end of a text leaves an empty word there
    n = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return flat.filter(filled), n[ends]


class Suffixes:
    """Suffix array of several sequences at once: sequences in turn, the suffixes of each in order, a shorter one first."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(ids)
        self.ids, self.first = ids, first
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[1:][self.doc]
        key = self.doc * (int(ids.max(initial=0)) + 1) + ids
        sa = np.argsort(key)
        head, tied = self._groups(key[sa])
        rank = np.empty(n, np.int64)
        rank[sa] = head
        slots = np.flatnonzero(tied)
        #: For k = 1, 2, 4, ...: the places whose first k words are not unique, and numbers that tell these apart.
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        k = 1
        while len(slots):
            at = sa[slots]
            own = rank[at]
            self.levels.append((k, at.astype(np.int32), own.astype(np.int32)))
            second = np.where(at + k < self.end[at], rank[np.minimum(at + k, n - 1)] + 1, 0)
            key = own * (n + 1) + second
            order = np.argsort(key)
            at = at[order]
            sa[slots] = at
            head, tied = self._groups(key[order])
            rank[at] = slots[head]
            slots = slots[tied]
            k *= 2
        self.sa, self.rank = sa, rank

    @staticmethod
    def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place of the group of each sorted key, whether the group has others)."""
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new[:-1], np.arange(len(key)), 0))
        return head, ~(new[:-1] & new[1:])

    def neighbours(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lcp, shift) of the chosen sequences: lcp[rank - shift[doc]] is the common prefix with the suffix ranked before."""
        lengths = np.diff(self.first)[docs]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        shift = np.zeros(len(self.first) - 1, np.int64)
        shift[docs] = self.first[:-1][docs] - starts
        slots = np.repeat(self.first[:-1][docs] - starts, lengths) + np.arange(lengths.sum())
        b = self.sa[slots]
        a = self.sa[np.maximum(slots - 1, 0)]
        pairs = np.flatnonzero(self.doc[a] == self.doc[b])
        pairs = pairs[slots[pairs] > 0]
        a, b = a[pairs], b[pairs]
        off = np.zeros(len(pairs), np.int64)
        number = np.full(len(self.ids) + 1, -1, np.int32)
        for k, at, own in reversed(self.levels):
            number[at] = own
            x, y = a + off, b + off
            inside = (x < self.end[a]) & (y < self.end[b])
            x, y = number[np.where(inside, x, -1)], number[np.where(inside, y, -1)]
            off += k * ((x >= 0) & (x == y))
            number[at] = -1
        lcp = np.zeros(len(slots), np.int64)
        lcp[pairs] = off
        return lcp, shift


class RangeMinimum:
    """Minima of ranges: prefix and suffix minima inside blocks, a sparse table over the minima of blocks."""

    def __init__(self, values: np.ndarray):
        n = max(1, -(-len(values) // BLOCK))
        grid = np.full(n * BLOCK, np.iinfo(np.int64).max)
        grid[: len(values)] = values
        self.flat, grid = grid, grid.reshape(n, BLOCK)
        self.before = np.minimum.accumulate(grid, axis=1).ravel()
        self.after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while 2 << (len(self.table) - 1) <= n:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over low..high, both included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.after[low], self.before[high])
        far = np.flatnonzero(b - a > 1)
        if len(far):
            width = b[far] - a[far] - 1
            level = np.frexp(width.astype(np.float64))[1] - 1
            for k in np.unique(level):
                own = far[level == k]
                out[own] = np.minimum(out[own], np.minimum(self.table[k][a[own] + 1], self.table[k][b[own] - (1 << int(k))]))
        near = np.flatnonzero(a == b)
        for own in np.split(near, range(1 << 16, len(near), 1 << 16)):
            reach = low[own][:, None] + np.arange(BLOCK)
            out[own] = self.flat[np.minimum(reach, high[own][:, None])].min(axis=1)
        return out


def next_smaller(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the next one of its sequence with a smaller value, or the sequence's end. Values differ."""
    n, docs = len(values), len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    walled = np.full(n + docs, -1, np.int64)  # a wall smaller than all after each sequence
    place = np.arange(n) + doc
    walled[place] = values
    following = np.arange(1, n + docs + 1)
    active = place
    for _ in range(JUMPS):
        active = active[walled[following[active]] > walled[active]]
        if not len(active):
            break
        following[active] = following[following[active]]
    else:
        for d in np.unique(np.searchsorted(first[1:] + np.arange(docs), active)):
            _by_stack(walled, following, int(first[d] + d), int(first[d + 1] + d))
    return following[place] - doc


def _by_stack(values: np.ndarray, following: np.ndarray, low: int, high: int) -> None:
    open_: list[int] = []
    own = values[low : high + 1].tolist()
    out = list(range(len(own)))
    for i, x in enumerate(own):
        while open_ and own[open_[-1]] > x:
            out[open_.pop()] = i
        open_.append(i)
    following[low:high] = np.array(out[:-1], np.int64) + low


def find_runs(ids: np.ndarray, first: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (sequence, start, length, period) of all runs with length >= max(least, exponent * period), in that order.

    ``ids`` are numbers of words, sequence d from first[d] to first[d + 1]; ``exponent`` is 2 or more.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    none = np.zeros((0, 4), np.int64)
    if not len(ids):
        return none
    ids = ids.astype(np.int64)
    suffixes = Suffixes(ids, first)
    roots = []
    for order, values in enumerate((suffixes.rank, len(ids) - 1 - suffixes.rank)):
        j = next_smaller(values, first)
        i = np.arange(len(ids))
        # The first root of a run starts less than a period after it, so this many words after the root repeat it.
        needed = (exponent - 2) * (j - i) + 1
        fits = j + needed <= suffixes.end
        i, j, needed = i[fits], j[fits], needed[fits]
        for k in range(3):
            same = (needed <= k) | (ids[np.minimum(i + k, len(ids) - 1)] == ids[np.minimum(j + k, len(ids) - 1)])
            i, j, needed = i[same], j[same], needed[same]
        roots.append(np.stack([i, j, needed]))
    i, j, needed = np.concatenate(roots, axis=1)
    if not len(i):
        return none
    lcp, shift = suffixes.neighbours(np.unique(suffixes.doc[i]))
    minimum = RangeMinimum(lcp)

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        by = shift[suffixes.doc[x]]
        a, b = suffixes.rank[x] - by, suffixes.rank[y] - by
        return minimum(np.minimum(a, b) + 1, np.maximum(a, b))

    right = common(i, j)
    enough = right >= needed
    i, j, right = i[enough], j[enough], right[enough]
    end, period = j + right, j - i
    order = np.lexsort((i, period, end))
    i, end, period = i[order], end[order], period[order]
    new = np.ones(len(i), bool)
    new[1:] = (end[1:] != end[:-1]) | (period[1:] != period[:-1])
    i, end, period = i[new], end[new], period[new]
    # Left end: the largest k below the period for which the suffixes at i - k and i - k + period agree up to the run's end.
    low, high = np.zeros(len(i), np.int64), np.minimum(period - 1, i - first[:-1][suffixes.doc[i]])
    while True:
        wide = np.flatnonzero(low < high)
        if not len(wide):
            break
        middle = (low[wide] + high[wide] + 1) // 2
        x = i[wide] - middle
        agree = common(x, x + period[wide]) >= end[wide] - x - period[wide]
        low[wide[agree]] = middle[agree]
        high[wide[~agree]] = middle[~agree] - 1
    start = i - low
    long = end - start >= np.maximum(least, exponent * period)
    doc = suffixes.doc[start[long]]
    rows = np.stack([doc, start[long] - first[:-1][doc], (end - start)[long], period[long]], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _top(runs: list[dict]) -> dict | None:
    """The run of the greatest exact exponent; of equal ones the first, then the one of the shortest period."""
    return max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)


def describe(texts: pa.Array, exponent: int, least: int) -> tuple[list, list, list, pa.Array]:
    """(number of words, runs, top run, collapsed text) of each text."""
    words, first = words_of(texts)
    rows = find_runs(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), first, exponent, least) if len(words) else np.zeros((0, 4), np.int64)
    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    for d, start, length, period in rows.tolist():
        runs[d].append({"start": start, "length": length, "period": period})
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.add.at(edges, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
    stays = np.cumsum(edges[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(stays)])
    kept = pa.LargeListArray.from_arrays(pa.array(upto[first], pa.int64()), words.filter(pa.array(stays)))
    return np.diff(first).tolist(), runs, [_top(r) for r in runs], pc.binary_join(kept, pa.scalar(" ", pa.large_string()))


def with_runs(docs: DataFrame, text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """Add n_words, ``runs`` (all, by start and period), ``top_run`` (greatest exponent) and ``collapsed``: the words that no
    run holds after its first period, joined by one space. No shuffle."""
    ship(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"n_words", "runs", "top_run", "collapsed"} and c != text])
    schema = StructType.fromDDL(FOUND)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = to_arrow_schema(schema)
        for batch in batches:
            low = 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while low < batch.num_rows:
                done = int(sizes[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
                part = batch.slice(low, high - low)
                n, runs, top, collapsed = describe(part.column(at), exponent, least)
                new = [pa.array(n, pa.int64()), pa.array(runs, added.field("runs").type), pa.array(top, added.field("top_run").type), collapsed.cast(added.field("collapsed").type)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added.names])
                low = high

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *schema.fields]))


def collapsed_documents(docs: DataFrame, text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """The documents with their runs collapsed to one period; texts without a run stay as they are."""
    found = with_runs(docs, text, exponent, least)
    return found.withColumn(text, F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(text))).drop("n_words", "runs", "top_run", "collapsed")
