"""Chunks of documents: a recursive splitter (Arrow batches of Python) and a fixed one (JVM)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.session import ship

# Separators in order.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _spans(text: str, separator: str, size: int) -> Iterator[tuple[int, int]]:
    """Cuts of a text at the ends of its separators and of what lies between them: each span reaches as far as ``size``
    allows, or to the next place to cut where that lies beyond."""
    if separator:
        places = sorted({at for m in re.finditer(re.escape(separator), text) for at in m.span()} | {len(text)})
    else:
        places = range(1, len(text) + 1)
    at = 0
    while at < len(text):
        k = bisect_right(places, at + size)
        end = places[k - 1] if k and places[k - 1] > at else places[k]
        yield at, end
        at = end


def split_recursive(text: str | None, size: int = 400, overlap: int = 40, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about ``size`` characters along the coarsest separators that fit (the last one is "", single characters).

    A span that no separator of a level cuts short enough is split at the next level; the chunk before it takes the
    beginning's tail along. Every level then begins each chunk with the tail of the one before it, so chunks may be longer
    than ``size``. Blank chunks are dropped.
    """
    if not text or size <= 0 or len(text) <= size:
        return [text] if text else []
    chunks: list[str] = []
    after_short = False
    for start, end in _spans(text, separators[0], size):
        part = text[start:end]
        short = end - start <= size
        deeper = [part] if short else split_recursive(part, size, overlap, separators[1:] or ("",))
        if after_short and not short and deeper:
            chunks.append(chunks.pop() + deeper[0][-overlap:])
        chunks.extend(deeper)
        after_short = short
    tails = [c[-overlap:] if overlap > 0 else "" for c in chunks[:-1]]
    return [tail + own for tail, own in zip(["", *tails], chunks, strict=False) if own.strip() or tail.strip()]


def chunk_documents(docs: DataFrame, case_id: str, text: str, size: int = 400, overlap: int = 40) -> DataFrame:
    """case_id, ordinal, chunk_id (``{case}-c000``), text. One pass, no shuffle; chunks leave in Arrow batches."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k, chunks = [], [], []
            for case, t in zip(batch.column(0), batch.column(1), strict=True):
                own = split_recursive(t.as_py(), size, overlap)
                ids += [case.as_py()] * len(own)
                k += range(len(own))
                chunks += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(k, pa.int32()), pa.array(chunks, pa.string())], names=["case_id", "ordinal", "text"])

    cut = docs.select(F.col(case_id).cast("string"), F.col(text).cast("string")).mapInArrow(run, "case_id string, ordinal int, text string")
    return cut.select("case_id", "ordinal", F.format_string("%s-c%03d", "case_id", "ordinal").alias("chunk_id"), "text")


def with_chunks(docs: DataFrame, text: str, name: str = "chunks", size: int = 400, overlap: int = 40) -> DataFrame:
    """``docs`` with the chunks of each row's text as an array; a null or empty text has none. One pass, no shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = pa.array([split_recursive(t.as_py(), size, overlap) for t in batch.column(at)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, chunks], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))]))


def chunk_fixed(docs: DataFrame, case_id: str, text: str, size: int = 400, overlap: int = 40) -> DataFrame:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before; all in the JVM."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.ceil((n - overlap) / step), F.lit(1)).cast("int") - 1
    cut = docs.filter(n > 0).select(F.col(case_id).cast("string").alias("case_id"), F.col(text).alias("text_"), F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    return cut.select("case_id", "ordinal", F.format_string("%s-c%03d", "case_id", "ordinal").alias("chunk_id"), F.substring("text_", F.col("ordinal") * step + 1, F.lit(size)).alias("text"))
