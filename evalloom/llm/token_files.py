"""Token files: ids of all documents in ascending doc_id order, compressed by the context-mixing range coder.

Documents are dealt by range of doc_id (a text hash breaks ties), so each task writes one file whose place among the others
is known; a file is a run of segments (see ``range_coder``), each followed by an index of the documents that begin in it, and
a table of the segments. Writing tasks name their files by attempt and return them in a manifest, the only list that readers
use. Segments decode apart from each other, so files are read in ranges of ``span`` segments, each in a task of its own that
holds one segment; the document that begins last in a range is read on into the next one. A document's start is the ids in
the files before its own and in its file before it; one number a file, no row a document, reaches the driver.

File layout, little-endian: b"TOKF", version u32; for each segment its bytes and its index (zlib: doc ids i64, null as the least
one; ids a document u64); the table, u64 each: offset of a segment, ids of the file before it, its bytes, documents that begin in
it, ids of the file before the first of these; then segments u64, documents u64, b"FEND".

Defined results
* null or empty text: the end id alone. Null ids come first. Rows that share a doc_id stand in the order of their text
  hashes, equal rows in any order.
* long documents span segments. An empty table gives no files and an empty result. Only the columns named are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm import range_coder
from evalloom.llm.common import materialize, new_path
from evalloom.llm.tokens import word_cache
from evalloom.llm.warc import open_store
from evalloom.session import ship

HEAD, TAIL = struct.Struct("<4sI"), struct.Struct("<QQ4s")
ROW = 40  # bytes of a row of the table
NULL_ID = -(1 << 63)


class FileWriter:
    """Collects ids and writes a segment whenever one is full."""

    def __init__(self, sink, block: int = range_coder.BLOCK, lanes: int = range_coder.LANES):
        self.sink, self.size, self.block, self.lanes = sink, 0, block, lanes
        self.held: list[bytes] = []
        self.room = 0
        self.full = 2 * block * lanes
        self.ids = self.first = self.documents = 0  # all ids added; ids and documents written
        self.open: list[tuple[int, int, int]] = []  # documents that begin in what is held: doc id, start, length
        self.table: list[tuple[int, ...]] = []
        self._write(HEAD.pack(b"TOKF", 2))

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """``raw``: the document's ids, u16, at least one."""
        self.open.append((NULL_ID if doc_id is None else doc_id, self.ids, len(raw) // 2))
        self.ids += len(raw) // 2
        self.held.append(raw)
        self.room += len(raw)
        if self.room >= self.full:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        raw = b"".join(self.held)
        cut = len(raw) if last else len(raw) // self.full * self.full
        for at in range(0, cut, self.full):
            ids = np.frombuffer(raw[at : min(at + self.full, cut)], "<u2")
            begun = bisect_left(self.open, self.first + len(ids), key=lambda d: d[1])
            docs, self.open = self.open[:begun], self.open[begun:]
            data = range_coder.encode_segment(ids, self.block)
            self.table.append((self.size, self.first, len(data), len(docs), docs[0][1] if docs else 0))
            self._write(data)
            self._write(zlib.compress(np.array([d[0] for d in docs], "<i8").tobytes() + np.array([d[2] for d in docs], "<u8").tobytes(), 6))
            self.first += len(ids)
            self.documents += len(docs)
        self.held, self.room = [raw[cut:]], len(raw) - cut

    def close(self) -> None:
        self._flush(True)
        self._write(np.array(self.table, "<u8").tobytes() + TAIL.pack(len(self.table), self.documents, b"FEND"))
        self.sink.close()


class FileReader:
    """Documents of an open token file (read, seek, size) by ranges of segments."""

    def __init__(self, source):
        self.source = source
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        if size < HEAD.size + TAIL.size or self._bytes(0, 4) != b"TOKF":
            raise ValueError("not a token file")
        self.segments, self.documents, mark = TAIL.unpack(self._bytes(size - TAIL.size, TAIL.size))
        self.end = size - TAIL.size - ROW * self.segments
        if mark != b"FEND" or self.end < HEAD.size:
            raise ValueError("a damaged token file")
        self.table = np.frombuffer(self._bytes(self.end, ROW * self.segments), "<u8").astype(np.int64).reshape(-1, ROW // 8)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _segment(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a segment; ids and lengths of the documents that begin in it."""
        offset, _, size, docs, _ = self.table[k].tolist()
        after = int(self.table[k + 1, 0]) if k + 1 < self.segments else self.end
        data = self._bytes(offset, after - offset)
        ids, end = range_coder.decode_segment(data)
        index = zlib.decompress(data[size:])
        if end != size or len(index) != 16 * docs:
            raise ValueError(f"the index of segment {k} does not match it")
        return ids, np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<u8", docs, 8 * docs).astype(np.int64)

    def read(self, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc id, start in the file, ids) of every document that begins in the segments from ``low`` to before ``high``."""
        ahead = None
        for k in range(low, self.segments if high is None else min(high, self.segments)):
            if not self.table[k, 3]:  # a document covers it
                continue
            ids, docs, lengths = ahead[1] if ahead and ahead[0] == k else self._segment(k)
            before = int(self.table[k, 1])
            at = int(self.table[k, 4]) - before
            for doc, n in zip(docs.tolist(), lengths.tolist(), strict=True):
                parts, have, j = [ids[at : at + n]], min(n, len(ids) - at), k
                while have < n:  # the last that begins here goes on
                    j += 1
                    if j >= self.segments:
                        raise ValueError("the index does not match the segments")
                    ahead = (j, self._segment(j))
                    parts.append(ahead[1][0][: n - have])
                    have += len(parts[-1])
                yield doc, before + at, parts[0] if len(parts) == 1 else np.concatenate(parts)
                at += n
            if k + 1 == self.segments and at != len(ids):
                raise ValueError("the index does not match the segments")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write the files; returns the manifest (part, path, documents, ids, segments, bytes)."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary)
        store, base = open_store(folder)
        writer, name = None, ""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256).to_pylist()
                raws = cache.encode([t or "" for t in batch.column(1).slice(at, 256).to_pylist()])
                for doc, raw in zip(ids, raws, strict=True):
                    if writer is None:
                        store.create_dir(base, recursive=True)
                        name = f"tokens-{uuid.uuid4().hex}.tok"
                        writer = FileWriter(store.open_output_stream(f"{base}/{name}", compression=None))
                    writer.add(doc, raw + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"], "documents": [writer.documents], "ids": [writer.ids], "segments": [len(writer.table)], "bytes": [writer.size]})

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return materialize(ordered.mapInArrow(run, "part long, path string, documents long, ids long, segments long, bytes long"), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False, span: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32[, ids: u32 bytes] of every document in the files."""
    spark = manifest.sparkSession
    ship(spark)
    files = sorted(manifest.select("part", "path", "ids", "segments").collect())
    places, before = [], 0
    for r in files:
        places.append((r["path"], before, r["segments"]))
        before += r["ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(path) as source:
                    for doc, start, ids in FileReader(source).read(row["low"], row["low"] + span):
                        raw = ids.astype("<u4").tobytes()
                        rows.append((None if doc == NULL_ID else doc, row["before"] + start, len(ids), zlib.crc32(raw)) + ((raw,) if with_ids else ()))
                        held += len(raw) if with_ids else 128
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    listed = spark.createDataFrame(places, "path string, before long, segments long")
    cut = listed.select("path", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1, F.lit(span).cast("long"))).alias("low"))
    tasks = sum(-(-n // span) for *_, n in places)
    return cut.repartition(max(1, min(tasks, 20_000))).mapInArrow(run, kinds)


def round_trip(docs: DataFrame, *, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    return read_tokens(write_tokens(docs, new_path(docs.sparkSession, "tokens"), vocabulary, end_id))
