"""Code on the executors, and tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Limits of an Arrow batch: rows here are documents, and 10,000 of them (Spark's default) can be gigabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; they need no installed copy of it.

    The session's Arrow batches are kept small where it asks for larger ones: memory of Python bodies is then bounded by a
    few documents, not by the table.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            said = spark.conf.get(name).lower().removesuffix("b")
        except Exception:  # a version of Spark without this setting
            continue
        if not said.isdigit() or not 0 < int(said) <= most:
            spark.conf.set(name, str(most))
    context = spark.sparkContext
    if getattr(context, "_evalloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="evalloom-code-")
    archive = os.path.join(folder, "evalloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix in {".py", ".json", ".yaml"}:
                z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(archive)
    context._evalloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; unset, a temporary one where both are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it names the folder that all machines share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="evalloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/evalloom/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone; the folder belongs to the job and can be swept later
        pass


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Column) -> DataFrame:
    """Rows with their ``place`` (from 0) in that order: ranges are sorted apart; a count for each range reaches the driver."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), order).sortWithinPartitions(order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialize(ranges.select("*", F.spark_partition_id().alias("range_"), within.alias("within_")), "numbered")
    before, starts = 0, []
    for r in sorted(rows.groupBy("range_").agg(F.count("*").alias("n")).collect()):
        starts.append((r["range_"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "range_ int, start_ long"))
    return rows.join(starts, "range_").withColumn("place", F.col("start_") + F.col("within_")).drop("range_", "start_", "within_")
