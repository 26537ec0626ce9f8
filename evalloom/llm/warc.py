"""WARC archives: a writer with revisit records, and a splittable reader of compressed archives.

Files are gzip members one after another, one record a member, in a folder of any store that pyarrow's file systems open
(local, hdfs, s3, gs). A writing task puts its file under a name of its own attempt and returns it in a manifest, which is
the only list of files that readers use: a task that is retried or run twice leaves an unread file, never a record twice.

The reader splits files into byte ranges. A task looks for gzip's magic bytes from the start of its range, takes a place for
a record's beginning only if what is inflated there begins with a WARC header that parses, and then owns every record that
starts inside its range (the last may end beyond it). Payloads can hold bytes that look like a record, such as an archive in
an archive: so each range also reports where its own chain of records begins and ends. Files with a range that does not begin
where the chain before it ended are gone through once more, a task a file: it follows the chain over what the ranges reported
and reads again only the ranges that do not continue it.

Defined results
* null or empty payload: an empty block; equal payloads, the empty ones too, share one response from ``least`` bytes up.
* of equal payloads the record with the largest id is the response and the others revisit it; rows that share that id too are
  all responses. A null id is smaller than any other; payloads that only rows without an id have are responses.
* an empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.common import materialize, new_path
from evalloom.llm.screens import screen_bits, with_screen
from evalloom.session import ship

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uuid(page_id: int | None, url: str | None, digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{digest}"))


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """One gzip member. A revisit keeps the digest and length of the full payload in its header, and no block."""
    revisit = refers_to is not None
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{record_uuid(page_id, url, digest)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    block = b"" if revisit else payload
    lines.append(("Content-Length", str(len(block))))
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (names in lower case) and block, or None if ``data`` is no whole WARC record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError):
        return None
    block = data[end + 4 : end + 4 + n]
    return (fields, block) if len(block) == n else None


def mark_revisits(pages: DataFrame, payload: str, key: str, least: int) -> DataFrame:
    """Add digest_hex and refers_to. Only one row for each digest and task meets in the aggregate; payloads are shuffled
    where their digest may be a repeated one, in a join that Spark may split where one payload is frequent."""
    whole = pages.withColumn("digest_hex", F.sha1(F.col(payload)))
    last = whole.filter(F.length(payload) >= least).groupBy("digest_hex").agg(F.max(key).alias("last"), F.count("*").alias("copies")).filter("copies > 1")
    last = materialize(last.select(F.col("digest_hex").alias("repeated"), "last", F.xxhash64("digest_hex").alias("hash")), "digests")
    refers = F.when(F.col("last") != F.col(key), F.col("last")).when(F.col(key).isNull(), F.col("last")).alias("refers_to")
    columns = [F.col(f"`{c}`") for c in whole.columns]
    joined = lambda rows: rows.join(last.select("repeated", "last"), F.col("digest_hex") == F.col("repeated"), "left").select(*columns, refers)
    bits = screen_bits(last)
    if bits is None:
        return joined(whole)
    marked = with_screen(whole.withColumn("digest_hash", F.xxhash64("digest_hex")), "digest_hash", last.select("hash"), bits)
    rest = marked.filter("not maybe_").select(*columns, F.lit(None).cast(last.schema["last"].dataType).alias("refers_to"))
    return joined(marked.filter("maybe_")).unionByName(rest)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write page_id, url, payload (binary), refers_to as archives; returns the manifest (path, bytes, records)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        sink, path, size, records = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to, digest in zip(*(batch.column(i) for i in range(5)), strict=True):
                if sink is None:
                    store.create_dir(base, recursive=True)
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(f"{base}/{path}", compression=None)
                data = encode_record(page_id.as_py(), url.as_py(), payload.as_py(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers_to.as_py(), date, level)
                sink.write(data)
                size += len(data)
                records += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "bytes": [size], "records": [records]})

    written = pages.select(F.col("page_id").cast("long"), "url", "payload", F.col("refers_to").cast("long"), "digest_hex").mapInArrow(run, "path string, bytes long, records long")
    return materialize(written, "warc-manifest")


class RangeReader:
    """The records of one file that start in [start, end)."""

    def __init__(self, source, start: int, end: int, chunk: int = 1 << 20):
        self.source, self.start, self.end, self.chunk = source, start, end, chunk
        self.size = source.size()

    def inflate(self, at: int, limit: int | None = None) -> tuple[bytes, int] | None:
        """The member that begins at ``at`` and where it ends; with ``limit`` the first bytes only. None: no such member."""
        unpack = zlib.decompressobj(31)
        out, left = [], limit
        self.source.seek(at)
        step = 1 << 14
        while not unpack.eof:
            data = self.source.read(step)
            step = self.chunk
            if not data:
                return None
            try:
                got = unpack.decompress(data, left or 0) if left is not None else unpack.decompress(data)
            except zlib.error:
                return None
            out.append(got)
            at += len(data)
            if left is not None:
                left -= len(got)
                if left <= 0 or unpack.unconsumed_tail:
                    break
        return b"".join(out), at - len(unpack.unused_data)

    def begins(self, at: int) -> bool:
        """Whether a member that begins with a WARC header begins at ``at``."""
        size = 1 << 12
        while (got := self.inflate(at, size)) is not None:
            head = got[0]
            if not head.startswith(b"WARC/1."):
                return False
            if b"\r\n\r\n" in head:
                return b"\ncontent-length:" in head[: head.find(b"\r\n\r\n") + 2].lower()
            if len(head) < size:
                return False
            size *= 8
        return False

    def first(self) -> int | None:
        """The first record that begins in the range."""
        at, tail, base = self.start, b"", self.start
        while base - len(tail) < self.end:
            self.source.seek(base)
            data = self.source.read(self.chunk)
            if not data:
                return None
            window = tail + data
            low = base - len(tail)
            k = window.find(MAGIC)
            while k >= 0:
                at = low + k
                if at >= self.end:
                    return None
                if self.begins(at):
                    return at
                k = window.find(MAGIC, k + 1)
            base += len(data)
            tail = window[-(len(MAGIC) - 1) :]
        return None

    def records(self, at: int | None) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        """(offset, next offset, header, block) from the record at ``at`` on, while they start inside the range."""
        while at is not None and at < min(self.end, self.size):
            got = self.inflate(at)
            record = got and parse_record(got[0])
            if not record:
                raise ValueError(f"damaged record at byte {at}")
            yield at, got[1], *record
            at = got[1]


def ranges(spark: SparkSession, manifest: DataFrame, split: int) -> DataFrame:
    """path, start, end of the byte ranges of all files."""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long")))
    return manifest.filter("bytes > 0").select("path", "bytes", cuts.alias("start")).select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))


READ = "path string, start long, end long, first long, last long, offset long, record_type string, page_id long, payload_length long, payload_digest string, refers_to long, uri string, block binary"
_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("block", pa.binary())])


def _read_range(source, path: str, start: int, end: int, whole: bool, chain: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """The records of a range, then its mark: where its chain begins and ends, and as record_type what broke it. The chain
    begins at ``chain[0]`` (None: nowhere in the range), or without ``chain`` at the first record that is found."""

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    reader = RangeReader(source, start, end)
    first = chain[0] if chain else reader.first()
    at, rows, held, damage = first, [], 0, None
    try:
        for offset, after, head, block in reader.records(first):
            digest = head.get("warc-payload-digest", "").partition(":")[2]
            if head.get("warc-type") == "response" and sha1_base32(block) != digest:
                raise ValueError(f"the payload at byte {offset} does not match its digest")
            rows.append((path, start, end, None, None, offset, head.get("warc-type"), number(head.get("x-page-id")), number(head.get("x-payload-length")), digest, number(head.get("x-refers-to-page-id")), head.get("warc-target-uri"), block if whole else None))
            at = after
            held += len(block)
            if held > 8 << 20 or len(rows) >= 4096:
                yield batch(rows)
                rows, held = [], 0
    except ValueError as e:  # a real one only if the chain led here: told apart when all ranges are read
        damage = str(e)
    yield batch([*rows, (path, start, end, first, at, None, damage, None, None, None, None, None, None)])


def _read(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as source:
                    yield from _read_range(source, row["path"], row["start"], row["end"], whole)

    return run


def _follow(whole: bool):
    """The ranges of a file (path, marks) that do not continue its chain, read again from where they have to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                due = 0
                with store.open_input_file(path) as source:
                    for mark in sorted(row["marks"], key=lambda m: m["start"]):
                        begun = due if due < mark["end"] else None
                        last, damage = mark["last"], mark["damage"]
                        if mark["first"] != begun:
                            for again in _read_range(source, row["path"], mark["start"], mark["end"], whole, (begun,)):
                                yield again
                            last, damage = again.column("last")[-1].as_py(), again.column("record_type")[-1].as_py()
                        if damage:  # the chain led here: the driver reports it
                            yield pa.RecordBatch.from_pylist([{"path": row["path"], "record_type": damage}], schema=_SCHEMA)
                            break
                        due = due if last is None else last

    return run


def read_archives(manifest: DataFrame, split: int = 4 << 20, whole: bool = True) -> DataFrame:
    """Every record of the manifest's files: path, offset, record_type, page_id, payload_length, payload_digest, refers_to,
    uri, block (null unless ``whole``; a revisit's is empty)."""
    spark = manifest.sparkSession
    ship(spark)
    parts = ranges(spark, manifest, split)
    tasks = max(1, min(10_000, parts.count()))
    dealt = parts.repartition(tasks, F.xxhash64("path", "start"))
    got = materialize(dealt.mapInArrow(_read(whole), READ), "warc-records")
    broken = _broken_chains(got)
    if broken is not None:
        again = materialize(broken.mapInArrow(_follow(whole), READ), "warc-again")
        real = again.filter("start is null").take(1)
        if real:
            raise ValueError(f"{real[0]['path']}: {real[0]['record_type']}")
        replaced = again.filter("offset is null").select("path", "start")
        got = got.join(replaced, ["path", "start"], "left_anti").select(*got.columns).unionByName(again)
    return got.filter("offset is not null").drop("start", "end", "first", "last")


def _broken_chains(got: DataFrame) -> DataFrame | None:
    """(path, marks) of the files with a range that does not begin where the chain of records before it ends, or None.

    One row a range; a range without a record of its own passes the place on. Windows and lists are per file, of some 40 bytes
    a range.
    """
    marks = got.filter("offset is null").select("path", "start", "end", "first", "last", F.col("record_type").alias("damage"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    due = marks.withColumn("due", F.coalesce(F.max("last").over(before), F.lit(0)))
    begun = F.when(F.col("due") < F.col("end"), F.col("due"))  # else a record covers the whole range, or the file is over
    wrong = due.filter(~F.col("first").eqNullSafe(begun) | F.col("damage").isNotNull())
    least = wrong.groupBy("path").agg(F.min_by(F.struct(F.col("first").eqNullSafe(begun).alias("led_here"), "damage"), "start").alias("x"))
    files = materialize(least.select("path", "x.*"), "warc-broken")
    real = files.filter("led_here").take(1)
    if real:
        raise ValueError(f"{real[0]['path']}: {real[0]['damage']}")
    if files.isEmpty():
        return None
    return marks.join(files.select("path"), "path").groupBy("path").agg(F.collect_list(F.struct("start", "end", "first", "last", "damage")).alias("marks"))


def round_trip(pages: DataFrame, *, least: int = 0, split: int = 4 << 20) -> DataFrame:
    """Archive page_id, url, html and read the archives back."""
    spark = pages.sparkSession
    flat = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b"")).alias("payload"))
    manifest = write_archives(mark_revisits(flat, "payload", "page_id", least), new_path(spark, "warc"))
    return read_archives(manifest, split, whole=False)
