"""JSON lines with their place: files are split into byte ranges and read in parallel, and every line still knows its number.

"First in the file", "the first N lines" and ties that the earlier line wins need an order that survives a split file. The
text scan cuts files into byte ranges (blocks) and keeps the order inside one; it tells each row its file and where its block
starts. A first pass, which reads no column, counts the lines of every block; running sums over these counts, a row a block,
give the number of its first line; the second pass adds a line's place inside its block. No line is shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.session import materialize
from evalloom.sources.schemas import SCHEMAS


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, line, place) of every line of the files: ``line`` counts from 1 in its file, ``place`` from 0 over all
    files in the order of their paths. Blank lines count. Files must not change between the passes."""
    # Rows of a task come block by block, so numbers inside a task are those of its blocks from some start on.
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row_"))
    blocks = materialize(text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n_"), F.min("row_").alias("start_")), "blocks")
    before = lambda w: F.sum("n_").over(w.orderBy("file", "block")) - F.col("n_")
    firsts = blocks.select(F.col("file").alias("file_"), F.col("block").alias("block_"), "start_", before(Window.partitionBy("file")).alias("lines_"), before(Window.partitionBy(F.lit(0))).alias("places_"))
    firsts = materialize(firsts, "first-lines")
    rows = text.join(firsts, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    inside = F.col("row_") - F.col("start_")
    return rows.select("value", "file", (F.col("lines_") + inside + 1).alias("line"), (F.col("places_") + inside).alias("place"))


def records(lines: DataFrame, record: str, bad: str = "skip", case_id: str | None = None) -> DataFrame:
    """The records of numbered lines, with file, line and place. ``record`` names a schema or is one.

    ``bad``: "skip" drops lines that do not parse, "keep" returns them in ``_corrupt_record``, "fail" ends the read. Blank
    lines are skipped. With ``case_id`` only its records are returned, and lines that cannot hold it are not parsed.
    """
    if bad not in ("skip", "keep", "fail"):
        raise ValueError("bad lines are skipped, kept, or fail the read")
    schema = SCHEMAS.get(record, record)
    lines = lines.filter(F.regexp_like("value", F.lit(r"[^ \t\r\n]")))
    if case_id is not None:
        # An escape can spell any character, so lines with one are parsed too.
        lines = lines.filter(F.contains("value", F.lit(case_id)) | F.contains("value", F.lit("\\")))
    mode = {"mode": "FAILFAST" if bad == "fail" else "PERMISSIVE"}
    parsed = F.from_json("value", schema + ("" if bad == "fail" else ", _corrupt_record string"), mode)
    rows = lines.select(parsed.alias("r"), "file", "line", "place").select("r.*", "file", "line", "place")
    if bad == "skip":
        rows = rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return rows if case_id is None else rows.filter(F.col("case_id") == case_id)


def ordered_jsonl(spark: SparkSession, path: str | list[str], record: str, bad: str = "skip", case_id: str | None = None) -> DataFrame:
    """JSON lines with the number of each; see ``records``."""
    return records(numbered_lines(spark, path), record, bad, case_id)


def scores_with_summary(spark: SparkSession, path: str | list[str], record: str) -> tuple[DataFrame, DataFrame]:
    """The score rows of a file with place, and of its ``{"SUMMARY": ...}`` lines the first one, as JSON."""
    lines = numbered_lines(spark, path)
    summary = F.get_json_object("value", "$.SUMMARY")
    first = lines.filter(summary.isNotNull()).agg(F.min_by(summary, "place").alias("summary")).filter(F.col("summary").isNotNull())
    return records(lines.filter(summary.isNull()), record), first
