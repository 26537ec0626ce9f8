"""Rate limits whose window opens with the first hit: of each key, hits count for 60 s from the first one after the last window.

Where windows start depends on all windows before, which looks sequential for each key. It is not: time is cut into chunks of
ten windows, and what a chunk does to the window that is open when it begins is a function that can be found for every chunk
apart. Three passes: all chunks in parallel find where each possible first window leads; a short chain a key, a few rows a
chunk, says which window is open at the start of each; and all chunks in parallel mark the windows. A hot key is spread over
as many tasks as it has chunks; a task holds the distinct times of some chunks of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.session import materialize, ship

#: Windows in a chunk.
WINDOWS = 10
NEVER = -(1 << 62)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (key, chunk) groups; rows come sorted."""
    held: list[pa.RecordBatch] = []
    of = lambda batch, at: (batch.column("k")[at].as_py(), batch.column("chunk")[at].as_py())
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and of(held[-1], -1) != of(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        at = batch.num_rows
        while at and of(batch, at - 1) == of(batch, -1):
            at -= 1
        if at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


class _Hits:
    """Times of whole (key, chunk) groups, and the hit that would open the window after the one that each hit opens."""

    def __init__(self, table: pa.Table, window: int, length: int):
        self.k = table.column("k").combine_chunks()
        self.chunk = table.column("chunk").to_numpy()
        self.t = table.column("t").to_numpy()
        n = len(self.t)
        codes = self.k.dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        new = np.ones(n, bool)
        new[1:] = (codes[1:] != codes[:-1]) | (self.chunk[1:] != self.chunk[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.end = np.append(self.first[1:], n)
        span = length + 2 * window
        place = self.group * span + (self.t - self.chunk * length)
        self.following = np.searchsorted(place, place + window)


def _steps(window: int, length: int):  # noqa: ANN202
    """(k, chunk, upto, leaves): a first window that opens at up to ``upto`` leaves one that ends at ``leaves``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            h = _Hits(table, window, length)
            own = np.arange(len(h.t))
            last = np.where(h.following < h.end[h.group], h.following, own)
            while True:
                further = last[last]
                if (further == last).all():
                    break
                last = further
            # Windows before the chunk end less than a window after its start, so hits up to the first one from there on
            # may open the chunk's first window.
            start = h.chunk * length
            may = h.t < start + window
            late = h.first + np.add.reduceat(may.astype(np.int64), h.first)
            may[late[late < h.end]] = True
            at = own[may]
            leaves = h.t[last[at]] + window
            turn = np.ones(len(at), bool)
            turn[:-1] = (leaves[1:] != leaves[:-1]) | (h.group[at[1:]] != h.group[at[:-1]])
            at, leaves = at[turn], leaves[turn]
            yield pa.RecordBatch.from_arrays([h.k.take(pa.array(at)), pa.array(h.chunk[at]), pa.array(h.t[at]), pa.array(leaves)], names=["k", "chunk", "upto", "leaves"])

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, chunk, opens): the end of the window that is open when a chunk of the key begins."""
    key, chunk, opens, done = None, None, NEVER, True
    for batch in batches:
        out: list[tuple] = []
        for k, c, upto, leaves in zip(*(batch.column(x).to_pylist() for x in ("k", "chunk", "upto", "leaves"))):
            if k != key:
                key, chunk, opens = k, None, NEVER
            if c != chunk:
                chunk, done = c, False
                out.append((k, c, opens))
            if not done and upto >= opens:
                opens, done = leaves, True
        if out:
            ks, cs, os = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(cs, pa.int64()), pa.array(os, pa.int64())], names=["k", "chunk", "opens"])


def _marks(window: int, length: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            h = _Hits(table, window, length)
            opens = table.column("opens").to_numpy()
            before = h.t < opens  # still in the window that was open
            anchor = np.where(before, opens - window, NEVER)
            at = h.first + np.add.reduceat(before.astype(np.int64), h.first)
            end = h.end
            while len(at):
                at, end = at[at < end], end[at < end]
                anchor[at] = h.t[at]
                at = h.following[at]
            starts = np.maximum.accumulate(np.where(anchor > NEVER, np.arange(len(anchor)), 0))
            yield pa.RecordBatch.from_arrays([h.k, pa.array(h.t), pa.array(anchor[starts])], names=["k", "t", "anchor"])

    return run


def windows_from_first_hit(hits: DataFrame, key: str, ts: str, seconds: int = 60, windows: int = WINDOWS) -> DataFrame:
    """(k, t, anchor): for each distinct time t (microseconds) of each key, as JSON, when its window opened."""
    spark = hits.sparkSession
    ship(spark)
    window = seconds * 1_000_000
    length = window * windows
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    times = hits.filter(F.col(ts).isNotNull()).select(F.to_json(F.struct(F.col(key).alias("k"))).alias("k"), t.alias("t")).distinct()
    times = materialize(times.withColumn("chunk", F.expr(f"cast(floor(t / {length}.0D) as long)")), "times")
    dealt = times.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "t")
    steps = materialize(dealt.mapInArrow(_steps(window, length), "k string, chunk long, upto long, leaves long"), "steps")
    opens = materialize(steps.repartition("k").sortWithinPartitions("k", "chunk", "upto").mapInArrow(_chain, "k string, chunk long, opens long"), "opens")
    marked = times.join(opens, ["k", "chunk"]).repartition("k", "chunk").sortWithinPartitions("k", "chunk", "t")
    return marked.select("k", "chunk", "t", "opens").mapInArrow(_marks(window, length), "k string, t long, anchor long")


def rate_limited_from_first_hit(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int = 60, windows: int = WINDOWS) -> DataFrame:
    """``window_start`` and ``allowed``: whether an event is among the first ``most`` of its window, which opens with the
    first event of its key that no earlier window holds. Refused events count in their window, but open none.

    Events of one time go by ``order``; copies in both are let through or refused together. An event without a time belongs
    to no window: both are null. A null key is a key of its own.
    """
    anchors = windows_from_first_hit(events, key, ts, seconds, windows)
    stamped = events.withColumns({"k_": F.to_json(F.struct(F.col(key).alias("k"))), "t_": F.unix_micros(F.col(ts).cast("timestamp"))})
    placed = stamped.join(anchors.withColumnsRenamed({"k": "a_", "t": "b_", "anchor": "anchor_"}), (F.col("k_") == F.col("a_")) & (F.col("t_") == F.col("b_")), "left").drop("a_", "b_")
    placed = materialize(placed, "placed")
    # The first rows of each window are cut off in every task before they are shuffled; their last one is the limit.
    first = F.row_number().over(Window.partitionBy("k_", "anchor_").orderBy("t_", order))
    few = placed.filter(F.col("anchor_").isNotNull()).select("k_", "anchor_", "t_", order).withColumn("n_", first).filter(F.col("n_") <= most)
    limit = few.groupBy(F.col("k_").alias("a_"), F.col("anchor_").alias("b_")).agg(F.max(F.struct("t_", F.col(order).alias("o_"))).alias("limit_"))
    out = placed.join(limit, (F.col("k_") == F.col("a_")) & (F.col("anchor_") == F.col("b_")), "left")
    within = F.when(F.col("anchor_").isNotNull(), F.coalesce(F.struct("t_", F.col(order).alias("o_")) <= F.col("limit_"), F.lit(False)))
    return out.select(*events.columns, F.timestamp_micros("anchor_").alias("window_start"), within.alias("allowed"))
