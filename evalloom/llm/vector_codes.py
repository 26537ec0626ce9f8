"""Product quantisation of vectors in integers: Lloyd rounds with Hamerly's bounds, then one byte a part.

A vector becomes integers floor(scale * x), cut into equal consecutive parts; each part position has its own codebook, which
starts as that part of the vectors with the smallest ids. A round gives every part to the nearest entry of its codebook
(squared Euclidean distance, ties to the lower index) and moves each entry to the componentwise floor of the mean of its
parts; entries without parts stay. After the rounds the parts are given out once more.

Hamerly's bounds spare most of the distances. Each part keeps two numbers between rounds: an upper bound of the distance to
its own entry and a lower bound of the distance to the second-nearest one. When entries move, the upper bound grows by the way
of its own entry, the lower one shrinks by the longest way of any other. While upper < lower strictly, no other entry can be
as near, so the part stays where it is; else the upper bound is made exact, and only if that fails too are all entries
scanned. Bounds are integers in units of 1/256, rounded up and down, so a skipped scan never changes a result, nor a tie.

On Spark: integers, entries and bounds of all vectors are written to the shared folder after each round (no shuffle), and
read for the next one; a lost executor costs one round. Tasks sum the parts of each entry first, so a round shuffles at most
parts x entries rows a task, and the driver receives one row an entry: parts x entries, whatever the table holds. Sums of
errors by label meet in partial aggregates, are written, and joined back (broadcast by Spark where their size allows).

Defined results: vectors that are null or hold null or non-finite components are left out; so are those that cannot be coded:
of a length that is not a positive multiple of ``parts``, of another length than the kept vector of the smallest id, or with a
component of 2^17 or more, whose exact distances no long can hold. Repeated ids and rows are vectors apart; where they start a
codebook, their components decide the order; a null id comes last. Fewer vectors than entries give shorter codebooks. Without
a ``label`` column all labels count as null. An empty table, or one without a vector to keep, gives no rows. Other columns
are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import private
from evalloom.session import materialize, ship

UNIT = 256
#: Integers below this keep all squared distances and their bounds exact in 64 bits.
MOST = 1 << 25
#: Bounds are written with 32 bits. An upper bound cut down to this is never below a lower one, so it spares no scan.
LARGEST = (1 << 31) - 1
#: Vectors that are compared with a whole codebook at a time.
ROWS = 4096


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor, ceil) of UNIT times the square roots of integers: floating point first, then set right in integers."""
    root = np.floor(np.sqrt(squares.astype(np.float64)) * UNIT).astype(np.int64)
    whole, rest = np.divmod(root, UNIT)  # (root / UNIT)^2 against squares without leaving 64 bits

    def above(whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Whether (whole + rest / UNIT)^2 > squares."""
        over = squares - whole * whole
        return (2 * whole * rest) * UNIT + rest * rest > over * (UNIT * UNIT)

    for _ in range(2):
        high = above(whole, rest) & (root > 0)
        root = root - high
        whole, rest = np.divmod(root, UNIT)
    for _ in range(2):
        more = ~above(*np.divmod(root + 1, UNIT))
        root = root + more
    whole, rest = np.divmod(root, UNIT)
    exact = (rest * (2 * whole * UNIT + rest)) == (squares - whole * whole) * (UNIT * UNIT)
    return root, root + ~exact


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance, that of the second-nearest) for rows of parts.

    Equal distances go to the lower index. Without a second entry its distance is the largest that counts.
    """
    n = len(x)
    best, near, second = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    for low in range(0, n, ROWS):
        part = x[low : low + ROWS]
        d = np.zeros((len(part), len(book)), np.int64)
        for k in range(x.shape[1]):
            step = part[:, k, None] - book[None, :, k]
            d += step * step
        at = d.argmin(axis=1)
        own = slice(low, low + len(part))
        rows = np.arange(len(part))
        best[own], near[own] = at, d[rows, at]
        if len(book) > 1:
            d[rows, at] = np.iinfo(np.int64).max
            second[own] = d.min(axis=1)
        else:
            second[own] = np.int64(1) << 58
    return best, near, second


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    step = x - entries
    return (step * step).sum(axis=1)


class Round:
    """One assignment of all parts: ``books`` [part, entry, component], and how far each entry moved since the last one."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None):
        self.books = books
        self.way = self.other = None
        if before is not None:
            moved = ((books - before) ** 2).sum(axis=2)
            self.way = _roots(moved)[1]
            # The longest way of any entry but the own one.
            order = np.sort(self.way, axis=1)
            second = order[:, -2] if order.shape[1] > 1 else np.zeros(len(order), np.int64)
            top = self.way.argmax(axis=1)
            self.other = np.repeat(order[:, -1:], books.shape[1], axis=1)
            self.other[np.arange(len(order)), top] = second

    def assign(self, x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, upper, lower) of each [vector, part], and how many parts were compared with all entries."""
        n, parts = x.shape[:2]
        if state is None:
            entry, upper, lower = (np.empty((n, parts), np.int64) for _ in range(3))
        else:
            entry, upper, lower = (a.astype(np.int64) for a in state)
        scanned = 0
        for p in range(parts):
            at = np.arange(n)
            if state is not None:
                upper[:, p] += self.way[p][entry[:, p]]
                lower[:, p] -= self.other[p][entry[:, p]]
                at = np.flatnonzero(upper[:, p] >= lower[:, p])
                exact = _roots(squared(x[at, p], self.books[p][entry[at, p]]))[1]
                upper[at, p] = exact
                at = at[exact >= lower[at, p]]
            if len(at):
                best, near, second = scan(x[at, p], self.books[p])
                entry[at, p], upper[at, p], lower[at, p] = best, _roots(near)[1], _roots(second)[0]
            scanned += len(at)
        return entry, upper, lower, scanned


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    """Integers of each vector, from a list or from the bytes that a round has written."""
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4") if pa.types.is_binary(column.type) else column.flatten().to_numpy()
    return flat.astype(np.int64).reshape(rows, -1)


def _packed(a: np.ndarray, kind: str) -> pa.Array:
    wide = a.shape[1] * np.dtype(kind).itemsize
    flat = np.ascontiguousarray(a.astype(kind)).tobytes()
    return pa.array([flat[i : i + wide] for i in range(0, len(flat), wide)], pa.binary())


def _unpacked(column: pa.Array, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def whole_numbers(vectors: DataFrame, id_column: str, vector: str, parts: int, scale: int) -> DataFrame:
    """(id, label, whole: array of long): the vectors that can be coded."""
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x * scale) < MOST), F.lit(False)))
    label = next((c for c in vectors.columns if c.lower() == "label"), None)
    kept = vectors.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & fits)
    label = F.col(label) if label else F.lit(None).cast("int")
    return kept.select(F.col(id_column).alias("id"), label.alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("whole"))


def _round(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """The rows with entries and bounds, or after the last round with code and error, of all vectors."""
    step = Round(books, before)
    parts, width = books.shape[0], books.shape[2]
    label = rows.schema["label"].dataType.simpleString()
    kept = rows.schema["id"].dataType.simpleString()
    columns = "code string, error long, scanned int" if last else "whole binary, entry binary, upper binary, lower binary, scanned int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = _vectors(batch.column("whole"), n)
            x = flat.reshape(n, parts, width)
            state = None if before is None else (_unpacked(batch.column("entry"), "u1", n), _unpacked(batch.column("upper"), "<i4", n), _unpacked(batch.column("lower"), "<i4", n))
            entry, upper, lower, scanned = step.assign(x, state)
            counts = pa.array(np.r_[scanned, np.zeros(n - 1, np.int64)], pa.int32())
            if last:
                error = sum(squared(x[:, p], books[p][entry[:, p]]) for p in range(parts))
                codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                new = {"code": pa.array(codes, pa.string()), "error": pa.array(error, pa.int64()), "scanned": counts}
            else:
                new = {"whole": _packed(flat, "<i4"), "entry": _packed(entry, "u1"), "upper": _packed(np.minimum(upper, LARGEST), "<i4"), "lower": _packed(np.clip(lower, -LARGEST, LARGEST), "<i4"), "scanned": counts}
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *new.values()], names=["id", "label", *new])

    return rows.mapInArrow(run, f"id {kept}, label {label}, {columns}")


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floor of the mean of its parts. A task's own sums are shuffled, then one row an entry collected."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _vectors(batch.column("whole"), n).reshape(n, parts, width)
            at = (_unpacked(batch.column("entry"), "u1", n).astype(np.int64) + np.arange(parts) * entries).ravel()
            counts += np.bincount(at, minlength=len(counts))
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
            sums[at[order][starts]] += np.add.reduceat(x.reshape(-1, width)[order], starts, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["at", "n", "sums"])

    partial = state.select("whole", "entry").mapInArrow(run, "at int, n long, sums array<long>")
    wide = lambda k: F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}")
    out = books.copy()
    for r in partial.groupBy("at").agg(F.sum("n").alias("n"), *[wide(k) for k in range(width)]).collect():
        out[r["at"] // entries, r["at"] % entries] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return out


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, scanned) of every vector that can be coded, the final codebooks [part, entry, component]).

    ``code`` is two hex digits a part, ``error`` the sum of the squared distances, ``scanned`` (summed over rows) the number
    of parts that were compared with a whole codebook in the last assignment.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    spark = vectors.sparkSession
    ship(spark)
    whole = whole_numbers(vectors, id_column, vector, parts, scale)
    # A top-n of each task first: parts x entries numbers reach the driver.
    start = whole.select("id", "whole").orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).collect()
    if not start:
        empty = whole.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("scanned")).filter(F.lit(False))
        return empty.withColumnRenamed("id", id_column), np.zeros((parts, 0, 0), np.int64)
    size = len(start[0]["whole"])
    if any(len(r["whole"]) != size for r in start):
        start = whole.filter(F.size("whole") == size).orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).collect()
    books = np.array([r["whole"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    rows = whole.filter(F.size("whole") == size)
    before = None
    for _ in range(rounds):
        rows = materialize(_round(rows, books, before, last=False), "codes")
        before, books = books, _moved(rows, books)
    return _round(rows, books, before, last=True).withColumnRenamed("id", id_column), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the error summed over equal labels, nulls together. The sums are written before the join."""
    own, total = private(coded, "own_label", "label_error")
    sums = materialize(coded.groupBy(F.col("label").alias(own)).agg(F.sum("error").alias(total)), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col(own)), "left").drop(own)
