"""Helpers that the training-data operators share: shared storage, column names, table reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.session import materialize, new_path, shared_dir

__all__ = ["materialize", "new_path", "shared_dir", "table", "private", "bound", "text_or_empty", "word_array", "word_count"]

#: A word is a run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions may use many times but that are computed once.

    A projection may be merged into the next one and its expressions copied into every use; a generator of one row ends
    that. Unlike a cache it holds no rows.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    """Number of words. The regular expression runs in the JVM; nothing is built."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
