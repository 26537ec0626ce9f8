"""Incremental twins of the batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalloom.session import ship
from evalloom.sources.versioned import VersionedTable


def stream_files(spark: SparkSession, schema: str, path: str, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder; the checkpoint of the query remembers which were read, so a restart resumes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def first_per_key(rows: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """One row for each key within the watermark; state is dropped behind it."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rate_by_minute(events: DataFrame, key: str, ts: str, most: int, late: str = "2 minutes") -> DataFrame:
    """Events and how many were over the limit, for each key and calendar minute."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("minute"), key, "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def append_finished(rows: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Append finished cases as they come, exactly once (file sink and checkpoint). Runs what is there and stops."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_latest(rows: DataFrame, key: list[str], ts: str, path: str, checkpoint: str, buckets: int = 64):  # noqa: ANN201
    """Keep the latest row of each key in a versioned table; a batch rewrites only the buckets of its keys. A batch that is
    repeated after a failure is known by its number and changes nothing."""
    there = VersionedTable(rows.sparkSession, path)
    if not there.versions():
        there.create(rows.schema, key, ts, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, path).upsert(batch, batch=(checkpoint, number))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _frames(rows: list[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    return iter([pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})] if rows else [])


class _FirstHitWindows(StatefulProcessor):
    """Hits wait until the watermark has passed them, then count in order in the window that their key's first one opened."""

    def __init__(self, most: int, seconds: int):
        self.most, self.window = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, place long")
        self.open = handle.getValueState("open", "start long, n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        first = None
        for batch in rows:
            for t, place in zip(batch["t"].tolist(), batch["place"].tolist()):
                self.waiting.appendValue((t, place))
                first = t if first is None else min(first, t)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        hits = sorted(self.waiting.get())
        due = [h for h in hits if h[0] < reached]
        later = hits[len(due) :]
        start, n = self.open.get() if self.open.exists() else (None, 0)
        out = []
        for t, place in due:
            if start is None or t >= start + self.window:
                start, n = t, 0
            n += 1
            out.append((key[0], t, place, start, n <= self.most))
        self.waiting.clear()
        for h in later:
            self.waiting.appendValue(h)
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        if start is not None:
            if not later and reached >= start + self.window:
                self.open.clear()  # no hit that is still to come can fall into this window
            else:
                self.open.update((start, n))
                self.handle.registerTimer((start + self.window) // 1000 + 1)
        return _frames(out, ["key", "t", "place", "window_start", "allowed"])

    def close(self) -> None:
        pass


def rate_from_first_hit(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``windows.rate_limited_from_first_hit``: (key, t, place, window_start, allowed), times in microseconds.

    A hit is decided when the watermark passes it, so hits that come late, but not later than ``late``, count in their place.
    State holds a key's undecided hits and its open window, and is dropped with them. ``order`` is a whole number.
    """
    ship(events.sparkSession)
    hits = events.withWatermark(ts, late).select(F.col(ts), F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts)).alias("t"), F.col(order).cast("long").alias("place"))
    out = "key string, t long, place long, window_start long, allowed boolean"
    return hits.groupBy("key").transformWithStateInPandas(_FirstHitWindows(most, seconds), out, "Append", "EventTime")


class _ExpiringKeys(StatefulProcessor):
    """The value of a key from its last put until it is deleted or its time is over; state goes with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, until long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        steps = pd.concat(list(rows)).sort_values(["t", "place"], kind="stable")
        value, until = self.held.get() if self.held.exists() else (None, 0)
        out = []
        for op, new, t, place, ttl in zip(steps["op"], steps["value"], steps["t"].tolist(), steps["place"].tolist(), steps["ttl_s"]):
            if op == "put":
                value, until = new, (-1 if pd.isna(ttl) else t + int(float(ttl) * 1_000_000))
            elif op == "delete":
                value = None
            else:
                out.append((key[0], place, value if until < 0 or t < until else None))
        if value is None:
            self.held.clear()
        else:
            self.held.update((value, until))
            if until >= 0:
                self.handle.registerTimer(until // 1000 + 1)
        return _frames(out, ["key", "place", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        if self.held.exists() and 0 <= self.held.get()[1] <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_values(steps: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Answers (key, place, value) of the "get" rows of a stream (key, op, value, ts, place, ttl_s): op is put, get or delete, a
    null ttl_s keeps a value for ever. Steps of a batch go by time, and behind those of the batches before."""
    ship(steps.sparkSession)
    rows = steps.withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(_ExpiringKeys(), "key string, place long, value string", "Append", "EventTime")


def unfinished(cases: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Cases of a stream whose key is not among the finished ones; these are read anew for each batch."""
    return cases.join(done.select(*key).distinct(), key, "left_anti")
