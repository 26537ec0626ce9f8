"""Keyed tables in versions: an upsert rewrites only the hash buckets that its keys fall in.

A table is a folder of runs and of manifests. A run holds the buckets that one write made; manifest N says, for version N, in
which run each bucket lies, so buckets that a write did not touch are shared between versions. A version exists from the
moment its manifest is whole: it is created under a name that must not exist yet, and one that a killed writer left unfinished
is passed over. Older versions stay readable until ``expire`` removes them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalloom.operators.logs import keep_latest

BUCKET = "bucket_"


class Conflict(RuntimeError):
    """Another writer made this version first; read the table again and repeat."""


@dataclass
class _Manifest:
    version: int = 0
    buckets: int = 64
    key: list[str] = field(default_factory=list)
    ts: str = ""
    schema: str = ""
    #: bucket -> run
    runs: dict[str, str] = field(default_factory=dict)
    #: stream -> its last batch
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """The latest row of each key. ``buckets`` is fixed when the table is made: some hundred megabytes a bucket are a good size."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, schema: StructType, key: list[str], ts: str, buckets: int = 64) -> VersionedTable:
        """Version 0: no rows."""
        self._write(_Manifest(0, buckets, key, ts, schema.json()))
        return self

    def versions(self) -> list[int]:
        """Numbers of all whole versions."""
        return [m.version for m in self._manifests()]

    def _names(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifests(self, newest_first: bool = False):  # noqa: ANN202
        for version in sorted(self._names(), reverse=newest_first):
            if m := self._manifest(version):
                yield m

    def _manifest(self, version: int) -> _Manifest | None:
        text = self._files.open(self._hadoop(f"{self.path}/manifests/{version}.json"))
        try:
            body = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(text, "UTF-8")
        finally:
            text.close()
        try:
            return _Manifest(**json.loads(body))
        except (ValueError, TypeError):  # its writer did not finish
            return None

    def _write(self, manifest: _Manifest) -> None:
        at = self._hadoop(f"{self.path}/manifests/{manifest.version}.json")
        try:
            out = self._files.create(at, False)
        except Exception as e:
            raise Conflict(f"version {manifest.version} exists") from e
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()

    def _current(self, version: int | None = None) -> _Manifest:
        if version is not None:
            found = self._manifest(version) if version in self._names() else None
        else:
            found = next(self._manifests(newest_first=True), None)
        if found is None:
            raise ValueError(f"no version {'' if version is None else version} of a table in {self.path}")
        return found

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the newest one by default."""
        m = self._current(version)
        return self._rows(m, list(m.runs))

    def _rows(self, m: _Manifest, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        folders = [f"{self.path}/runs/{m.runs[b]}/{BUCKET}={b}" for b in buckets if b in m.runs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, m: _Manifest):  # noqa: ANN202
        return F.pmod(F.xxhash64(*[F.col(k) for k in m.key]), F.lit(m.buckets)).cast("int")

    def _replace(self, m: _Manifest, rows: DataFrame, touched: list[str], batch: tuple[str, int] | None) -> int:
        """Write the new content of the touched buckets as a run, then the version that points to it."""
        run = uuid.uuid4().hex
        rows = rows.withColumn(BUCKET, self._bucket(m)).repartition(max(1, min(len(touched), m.buckets)), BUCKET)
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/runs/{run}")
        made = {s.getPath().getName().split("=", 1)[1] for s in self._files.listStatus(self._hadoop(f"{self.path}/runs/{run}")) if "=" in s.getPath().getName()}
        runs = {b: r for b, r in m.runs.items() if b not in touched} | {b: run for b in made}
        batches = m.batches | (dict([batch]) if batch else {})
        new = _Manifest(max([m.version, *self._names()]) + 1, m.buckets, m.key, m.ts, m.schema, runs, batches)
        self._write(new)
        return new.version

    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Keep the latest row of each key, of equal times the one that was there, then the first by ``order``. Returns the
        version. Rows without a key are all kept. A batch (stream, number) that is in the table already changes nothing.
        """
        m = self._current()
        if batch and m.batches.get(batch[0], -1) >= batch[1]:
            return m.version
        columns = StructType.fromJson(json.loads(m.schema)).names
        new = rows.withColumn("order_", F.col(order).cast("long") if order else F.monotonically_increasing_id()).select(*columns, "order_")
        # One number a bucket at the most reaches the driver.
        touched = [str(r[0]) for r in new.select(self._bucket(m)).distinct().collect()]
        if not touched:
            return m.version
        old = self._rows(m, touched).withColumn("order_", F.lit(-(1 << 62)).cast("long"))
        return self._replace(m, keep_latest(old.unionByName(new), m.key, m.ts, "order_").drop("order_"), touched, batch)

    def delete(self, keys: DataFrame) -> int:
        """Drop the rows of these keys; buckets without any of them are shared with the version before."""
        m = self._current()
        gone = keys.select(*m.key).distinct()
        may = [str(r[0]) for r in gone.select(self._bucket(m)).distinct().collect()]
        touched = [str(r[0]) for r in self._rows(m, may).join(gone, m.key, "left_semi").select(self._bucket(m)).distinct().collect()]
        if not touched:
            return m.version
        return self._replace(m, self._rows(m, touched).join(gone, m.key, "left_anti"), touched, None)

    def changed_buckets(self, version: int) -> int:
        """How many buckets of a version are not those of the version before."""
        older = [m for m in self._manifests() if m.version < version]
        before = older[-1].runs if older else {}
        now = self._current(version).runs
        return sum(before.get(b) != now.get(b) for b in {*before, *now})

    def expire(self, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` versions and remove the runs that none of these needs; returns how many runs.

        Runs younger than the newest version are left: a writer may be about to publish them.
        """
        found = list(self._manifests())
        stay, gone = found[-max(1, keep) :], found[: -max(1, keep)]
        needed = {r for m in stay for r in m.runs.values()}
        newest = self._files.getFileStatus(self._hadoop(f"{self.path}/manifests/{stay[-1].version}.json")).getModificationTime()
        for m in gone:
            self._files.delete(self._hadoop(f"{self.path}/manifests/{m.version}.json"), False)
        folder, n = self._hadoop(f"{self.path}/runs"), 0
        if self._files.exists(folder):
            for s in self._files.listStatus(folder):
                if s.getPath().getName() not in needed and s.getModificationTime() < newest:
                    n += bool(self._files.delete(s.getPath(), True))
        return n
