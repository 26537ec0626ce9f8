"""Calls to models from inside Spark tasks: several in flight, results in order, and no paid call made twice.

Equal prompts are called once. Distinct prompts are dealt to hash buckets; a task works through its buckets with a bounded
number of calls in flight, each thread with a client of its own, and writes every reply to the bucket's log as soon as it is
there. A task that is run again (a lost executor, a failure elsewhere, another run of the same job) reads the log of its
buckets first and only calls for what is missing. Errors are rows and are not logged, so they are tried again next time.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.session import ship

CALLED = "hash string, reply string, latency_ms double, status string, error string"


class ReplyLog:
    """Replies by prompt hash, in files of JSON lines under ``uri/bucket=<b>``; any file system that pyarrow knows."""

    def __init__(self, uri: str, bucket: int):
        self.files, root = fs.FileSystem.from_uri(uri)
        self.folder = f"{root.rstrip('/')}/bucket={bucket}"
        self.files.create_dir(self.folder, recursive=True)
        self.lock, self.out = threading.Lock(), None

    def replies(self) -> dict[str, dict]:
        found: dict[str, dict] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.folder)):
            if info.type != fs.FileType.File:
                continue
            with self.files.open_input_stream(info.path) as f:
                for line in f.read().splitlines():
                    try:
                        row = json.loads(line)
                        found[row["hash"]] = row
                    except (ValueError, KeyError, TypeError):  # a writer was killed in this line
                        continue
        return found

    def put(self, row: dict) -> None:
        line = (json.dumps(row) + "\n").encode()
        with self.lock:
            if self.out is None:
                path = f"{self.folder}/{uuid.uuid4().hex}.jsonl"
                self.files.open_output_stream(path).close()
                self.out = path
            try:
                with self.files.open_append_stream(self.out) as f:
                    f.write(line)
            except (NotImplementedError, pa.ArrowNotImplementedError):  # an object store: a file a reply
                with self.files.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl") as f:
                    f.write(line)


def in_order(work: Iterator, submit: Callable[[object], Future], most: int) -> Iterator:
    """Results of futures in the order of the work, with at most ``most`` of them unfinished or unread."""
    waiting: deque[Future] = deque()
    for item in work:
        waiting.append(submit(item))
        if len(waiting) >= most:
            yield waiting.popleft().result()
    while waiting:
        yield waiting.popleft().result()


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def call_prompts(prompts: DataFrame, make: Callable[[], Callable[[str], str]], log: str, in_flight: int = 12, buckets: int = 256) -> DataFrame:
    """(hash, reply, latency_ms, status, error) of distinct prompts (hash, prompt). ``buckets`` must not change between runs
    that share a log."""
    ship(prompts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs, known = threading.local(), {}, {}

        def one(item: tuple[str, str, int]) -> tuple:
            key, prompt, bucket = item
            done = known[bucket].get(key)
            if done:
                return key, done["reply"], done["latency_ms"], "ok", None
            begun = time.perf_counter()
            try:
                if not hasattr(own, "client"):
                    own.client = make()
                reply, status, error = own.client(prompt), "ok", None
            except Exception as e:  # noqa: BLE001  errors are rows
                reply, status, error = None, "error", f"{type(e).__name__}: {e}"
            taken = round((time.perf_counter() - begun) * 1000, 1)
            if status == "ok":
                logs[bucket].put({"hash": key, "reply": reply, "latency_ms": taken})
            return key, reply, taken, status, error

        def items() -> Iterator[tuple[str, str, int]]:
            for batch in batches:
                for key, prompt, bucket in zip(*(batch.column(c).to_pylist() for c in ("hash", "prompt", "bucket"))):
                    if bucket not in logs:
                        logs[bucket] = ReplyLog(log, bucket)
                        known[bucket] = logs[bucket].replies()
                    yield key, prompt, bucket

        with ThreadPoolExecutor(in_flight) as threads:
            rows: list[tuple] = []
            for row in in_order(items(), lambda item: threads.submit(one, item), 2 * in_flight):
                rows.append(row)
                if len(rows) >= 500:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    bucket = F.pmod(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    dealt = prompts.select("hash", "prompt", bucket.alias("bucket")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "hash")
    return dealt.mapInArrow(run, CALLED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["hash", "reply", "latency_ms", "status", "error"])


def call_model_once(rows: DataFrame, prompt: str, make: Callable[[], Callable[[str], str]], log: str, in_flight: int = 12, buckets: int = 256) -> DataFrame:
    """Add reply, latency_ms, status, error to every row: one call for each distinct prompt that ``log`` does not hold yet.

    A null prompt is not called: its status is "skipped".
    """
    key = prompt_hash(F.col(prompt))
    distinct = rows.filter(F.col(prompt).isNotNull()).groupBy(key.alias("hash")).agg(F.first(prompt).alias("prompt"))
    called = call_prompts(distinct, make, log, in_flight, buckets)
    out = rows.withColumn("hash_", key).join(called, F.col("hash_") == F.col("hash"), "left").drop("hash_", "hash")
    return out.withColumn("status", F.coalesce("status", F.lit("skipped")))


def sha256_hex(text: str) -> str:
    """The hash of a prompt as the log writes it."""
    return hashlib.sha256(text.encode()).hexdigest()
