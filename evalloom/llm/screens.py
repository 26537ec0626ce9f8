"""Screens: a broadcast bitmap of hashes that keeps rows which cannot match out of a join's shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A screen has eight bits a wanted value or more, 2 ** SCREEN_BITS at the most (32 MB); with more wanted values there is
#: none, and the join shuffles all rows.
SCREEN_BITS = 28


def with_screen(rows: DataFrame, column: str, wanted: DataFrame, bits: int) -> DataFrame:
    """Add ``maybe_``: whether ``column`` may be among ``wanted`` (one column of longs), by a broadcast bitmap of 2**bits
    bits."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    within = lambda p: p.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), within(F.col("p_")))
    words = wanted.select(place(wanted.columns[0]).alias("p_")).groupBy(F.shiftright("p_", 6).alias("word_")).agg(F.bit_or(one).alias("bits_"))
    found = rows.withColumn("p_", place(column)).join(F.broadcast(words), F.shiftright("p_", 6) == F.col("word_"), "left")
    hit = F.call_function("shiftright", F.coalesce("bits_", F.lit(0).cast("long")), within(F.col("p_"))).bitwiseAND(F.lit(1).cast("long")) == 1
    return found.withColumn("maybe_", hit).drop("p_", "word_", "bits_")


def screen_bits(wanted: DataFrame, each: int = 8) -> int | None:
    """``each`` bits for each of ``wanted`` (a table that is cheap to count), down to eight where the bitmap would be too large,
    or None where it still would be."""
    n = wanted.count()
    bits = min(max(10, (each * n).bit_length()), max(SCREEN_BITS, (8 * n).bit_length()))
    return bits if bits <= SCREEN_BITS else None


def screened(rows: DataFrame, column: str, wanted: DataFrame, each: int = 8) -> DataFrame:
    """The rows whose ``column`` may be among ``wanted``: most others stay out of the shuffle of the join that decides, all but
    one in ``each``, so wide rows ask for more bits. With more wanted values than a screen takes, all rows."""
    bits = screen_bits(wanted, each)
    return rows if bits is None else with_screen(rows, column, wanted, bits).filter("maybe_").drop("maybe_")


def without(rows: DataFrame, column: str, dropped: DataFrame) -> DataFrame:
    """The rows whose ``column`` is not among ``dropped``; only those that may be are shuffled."""
    bits = screen_bits(dropped)
    other = dropped.select(F.col(dropped.columns[0]).alias("dropped_"))
    if bits is None:
        return rows.join(other, F.col(column) == F.col("dropped_"), "left_anti")
    marked = with_screen(rows, column, dropped, bits)
    checked = marked.filter("maybe_").drop("maybe_").join(other, F.col(column) == F.col("dropped_"), "left_anti")
    return marked.filter("not maybe_").drop("maybe_").unionByName(checked)
