"""Writers: appends, versioned overwrites, per-task files, audit rows, vector collections, expiring keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.logs import update_rows


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def overwrite_ordered(rows: DataFrame, path: str, key: str = "case_id") -> None:
    """One globally ordered set of files (range partitions, in order); one file where the rows fit one partition."""
    rows.orderBy(key).write.mode("overwrite").json(path)


def new_version(rows: DataFrame, changed: DataFrame, key: list[str], path: str) -> DataFrame:
    """Write the updated table beside the old one, which stays as the backup."""
    out = update_rows(rows, changed, key)
    out.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def per_task(rows: DataFrame, path: str, task: str = "task") -> None:
    rows.write.mode("overwrite").partitionBy(task).json(path)


def audit_rows(rows: DataFrame, policy_version: str, source: str) -> DataFrame:
    """Redaction audit records of rows with case_id, span_count_by_type and total."""
    return rows.select(F.expr("uuid()").alias("id"), F.current_timestamp().alias("ts"), "case_id", F.lit(policy_version).alias("policy_version"), F.col("span_count_by_type").alias("span_count"), F.col("total").cast("int").alias("total_redactions"), F.lit(source).alias("source"))


def run_record(spark, phase: str, **more: str | None) -> DataFrame:  # noqa: ANN001
    """One run_metadata row with a fresh run_id."""
    columns = [F.lit(more.get(c)).cast("string").alias(c) for c in ("track", "config", "provider", "args")]
    return spark.range(1).select(F.expr("uuid()").alias("run_id"), F.current_timestamp().alias("ts"), F.lit(phase).alias("phase"), *columns)


def put_objects(objects: DataFrame, path: str) -> None:
    """Store objects (bucket, key, payload, content_type, metadata map) with their metadata; a later put of a key replaces it."""
    kinds = {"content_type": F.coalesce("content_type", F.lit("application/octet-stream")), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))}
    objects.select("bucket", "key", "payload", "content_type", "metadata").withColumns(kinds | {"put_at": F.current_timestamp()}).write.mode("append").partitionBy("bucket").parquet(path)


def stored_objects(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The last put of each key; payloads of one moment by their largest bytes."""
    last = spark.read.parquet(path).groupBy("bucket", "key").agg(F.max_by(F.struct("payload", "content_type", "metadata", "put_at"), F.struct("put_at", "payload")).alias("o"))
    return last.select("bucket", "key", "o.*")


def repeated_ids(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    return vectors.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def add_vectors(vectors: DataFrame, path: str, key: str = "chunk_id") -> int:
    """Add to a vector collection and return the size it has then; ids that repeat, among themselves or with what is there,
    are refused."""
    spark = vectors.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = None  # no collection yet
    every = vectors.select(key) if there is None else vectors.select(key).unionByName(there)
    if not repeated_ids(every, key).isEmpty():
        raise ValueError("repeated ids in the collection")
    vectors.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def without(vectors: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return vectors.join(ids.select(key), key, "left_anti")


def live(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Latest value of each key that has not expired (key, value, ts, ttl_s; null ttl: for ever)."""
    now = F.current_timestamp() if now is None else now
    last = entries.groupBy("key").agg(F.max_by(F.struct("value", "ts", "ttl_s"), "ts").alias("e")).select("key", "e.*")
    return last.filter(F.col("value").isNotNull() & (F.col("ttl_s").isNull() | (F.col("ts") + F.make_interval(secs=F.col("ttl_s")) > now)))
