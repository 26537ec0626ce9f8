"""Quality scores of documents: ridge regression on random Fourier features, calibrated by isotonic regression.

Document statistics (lengths, shares of character classes, repetition) are computed once per document and written; texts are
not shuffled. Random Fourier features approximate a Gaussian kernel over the standardised statistics. Each partition of
labelled rows sums its own normal equations (a matrix of fixed size); the sums are added in two levels and solved on the
driver. Scores of the training rows, counted in a fixed number of bins, give the isotonic map to probabilities.

Defined results
* null or empty text: the statistics of a text without words; it gets a score like any other.
* labels that are null are left out; a document with several labels counts with their mean. No labelled rows at all, or rows
  of one class only: every score is the mean label (0.5 without any).
* a null id is held out. Repeated rows get equal scores; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import materialize
from evalloom.llm.vector_text import Words, slices
from evalloom.session import ship

STATISTICS = ("log_words", "word_bytes", "word_bytes_sd", "symbols", "digits", "capitals", "all_caps", "stops", "exclamations", "lines", "distinct", "windows", "echoes", "non_ascii", "bars", "same_lines")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_SYMBOLS, _DIGITS, _CAPITALS, _STOPS = _class("#*$%&|<>~^=+_{}[]\\/@"), _class("0123456789"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(".,;:?")


def statistics(w: Words) -> np.ndarray:
    """One row of STATISTICS a text."""
    n_docs = len(w.offsets) - 1
    counts = w.counts
    n = np.maximum(counts, 1).astype(float)
    size = np.maximum(np.diff(w.offsets), 1).astype(float)
    doc = np.repeat(np.arange(n_docs), counts)

    def total(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return np.diff(sums[w.offsets]).astype(float)

    def per_doc(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, n_docs)

    def repeated(key: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Keys of each text that an earlier place of it has."""
        order = np.lexsort((key, of))
        k, o = key[order], of[order]
        return per_doc(((k[1:] == k[:-1]) & (o[1:] == o[:-1])).astype(float), o[1:])

    length = (w.ends - w.starts).astype(float)
    mean = per_doc(length, doc) / n
    spread = np.sqrt(np.maximum(per_doc(length**2, doc) / n - mean**2, 0))
    h = w.hashes()
    capital = _CAPITALS[w.data]
    sums = np.concatenate([[0], np.cumsum(capital, dtype=np.int64)])
    caps = ((sums[w.ends] - sums[w.starts]) >= np.maximum(2, 0.6 * length)).astype(float)
    triple = h[:-2] + h[1:-1] * np.uint64(3) + h[2:] * np.uint64(5) if len(h) > 2 else h[:0]
    inside = doc[:-2] == doc[2:] if len(h) > 2 else np.zeros(0, bool)
    echo = ((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])).astype(float)
    newline = w.data == 10
    # lines as (text, hash of the words' sum): words of a line summed by place in the line
    line_of = np.cumsum(newline)[w.starts] if len(w.starts) else np.zeros(0, np.int64)
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
        line_key = np.add.reduceat(h * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), at)
        same_lines = repeated(line_key, doc[at]) / np.maximum(per_doc(np.ones(len(at)), doc[at]), 1)
    else:
        same_lines = np.zeros(n_docs)
    return np.column_stack(
        [
            np.log1p(counts),
            mean,
            spread,
            total(_SYMBOLS[w.data]) / n,
            total(_DIGITS[w.data]) / size,
            total(capital) / size,
            per_doc(caps, doc) / n,
            total(_STOPS[w.data]) / n,
            total(w.data == 33) / n,
            total(newline) / n,
            1 - repeated(h, doc) / n,
            repeated(triple[inside], doc[:-2][inside] if len(h) > 2 else doc[:0]) / n,
            per_doc(echo, doc[1:]) / n,
            total(w.data >= 128) / size,
            total(w.data == 124) / n,
            same_lines,
        ]
    ).astype(np.float32)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of its STATISTICS."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(w) for _, w in slices(batch.column(1))]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)), np.float32)
            x = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(STATISTICS), dtype=np.int32), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<float>")


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


class Fourier:
    """sqrt(2 / D) cos(W z + b) of standardised statistics z, clipped to five deviations."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: float, features: int, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.w = random.normal(size=(len(mean), features)) / width
        self.b = random.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -5, 5)
        out = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.concatenate([out, np.ones((len(x), 1))], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1).astype(float)


def normal_equations(train: DataFrame, fourier: Fourier, groups: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over the rows (x, y): per partition, then in ``groups`` tasks, then on the driver."""
    d = len(fourier.b) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                f = fourier(matrix(some.column(0)))
                total += f.T @ np.column_stack([f, some.column(1).to_numpy()])
        yield pa.RecordBatch.from_pydict({"sum": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_py()).reshape(d, d + 1)
        yield pa.RecordBatch.from_pydict({"sum": [total.tobytes()]})

    rows = train.select("x", "y").mapInArrow(part, "sum binary").repartition(groups).mapInArrow(add, "sum binary").collect()
    total = sum((np.frombuffer(r["sum"]).reshape(d, d + 1) for r in rows), np.zeros((d, d + 1)))
    return total[:, :d], total[:, d]


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the weighted least-squares rising fit."""
    blocks: list[list[float]] = []
    for w, m in zip(weights, means, strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def calibration(raw: list[tuple[int, int, float]], bins: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw score, probability), strictly rising but for rounding, from (bin, rows, sum of labels)."""
    raw = sorted(raw)
    n = np.array([r[1] for r in raw], float)
    fit = isotonic(n, np.array([r[2] for r in raw]) / n)
    centre = low + (np.array([r[0] for r in raw]) + 0.5) * (high - low) / bins
    at, to = [low - 1.0], [0.0]
    for value in np.unique(fit):
        own = fit == value
        at.append(float((centre[own] * n[own]).sum() / n[own].sum()))
        to.append(float(np.clip(value, 0, 1)))
    return np.array([*at, high + 1.0]), np.array([*to, 1.0])


def score(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, features: int = 256, width: float = 4.0, ridge: float = 1e-3, bins: int = 2000, threshold: float = 0.3, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the held-out fold (remainder 0) are never read."""
    known = materialize(with_statistics(docs.select("doc_id", "text")), "statistics")
    fold = remainder(F.col("doc_id"), folds)
    taught = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    train = materialize(known.join(taught, "doc_id").select("x", "y"), "train")
    moments = [e for k in range(len(STATISTICS)) for e in (F.avg(F.col("x")[k].cast("double")), F.stddev_pop(F.col("x")[k].cast("double")))]
    row = train.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y"), *moments).first()
    held = F.coalesce(fold == 0, F.lit(True)).alias("held_out")
    if not row[0] or row[2] == row[3]:
        flat = F.lit(float(row[1]) if row[0] else 0.5)
        return known.select("doc_id", held, flat.alias("score"), (flat >= threshold).cast("int").alias("predicted"))
    fourier = Fourier(np.array(row[4::2], float), np.maximum(np.array(row[5::2], float), 1e-6), width, features, seed)
    a, b = normal_equations(train, fourier)
    solution = np.linalg.solve(a + ridge * row[0] * np.eye(len(a)) / len(a), b)
    low, high = -0.5, 1.5

    def raw(batches: Iterator[pa.RecordBatch], tail: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                yield some, np.clip(fourier(matrix(some.column(tail))) @ solution, low, high)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, s in raw(batches, 0):
            k = np.minimum(((s - low) / (high - low) * bins).astype(np.int64), bins - 1)
            yield pa.RecordBatch.from_arrays([pa.array(k), some.column(1)], names=["bin", "y"])

    found = train.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    knots, values = calibration([(r["bin"], r["n"], r["s"]) for r in found], bins, low, high)

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, s in raw(batches, 1):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.interp(s, knots, values))], names=["doc_id", "score"])

    scored = known.mapInArrow(calibrated, "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
