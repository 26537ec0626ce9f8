"""Stored vector collections with exact search that reads only the cells which can hold an answer.

Vectors are kept in cells around pivots, a small table beside them says how far the nearest and the farthest vector of each
cell lie from its pivot. By the triangle inequality no vector of a cell is nearer to a query than the query's distance to the
pivot less the cell's radius. A search goes in two rounds: the cells around a query that hold enough vectors give a bound of
the distance of its k-th neighbour, and then the cells that this bound does not rule out are compared by matrix products in
Arrow batches. Results are those of comparing everything.

Defined results: null ids and vectors, empty ones, and such with null or non-finite components are not stored; a query with one
finds nothing. All vectors of a collection have one length, that of the first pivot; others are not stored. Copies and repeated
ids are vectors apart. A cell of many copies is split over tasks by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from evalloom.session import materialize, ship

#: Bytes of queries that are sent to the tasks at a time.
MOST_BYTES = 64 << 20
#: Vectors are compared in pieces of so many pairs.
PAIRS = 1 << 21


def usable(vectors: DataFrame, item_id: str, vec: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.filter(F.col(item_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, as products say; good to some 1e-7 of the vectors' lengths."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _slack(*lengths: np.ndarray) -> float:
    return 1e-6 * (1 + max((float(np.abs(x).max(initial=0)) for x in lengths), default=0.0))


@dataclass
class Collection:
    """A collection in a folder; ``pivots`` [cell, component] and for each cell its least and largest distance and its size."""

    spark: SparkSession
    path: str
    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    size: np.ndarray

    @classmethod
    def write(cls, vectors: DataFrame, path: str, item_id: str = "item_id", vec: str = "vec", per_cell: int = 2000, most_cells: int = 2048) -> Collection:
        """Store vectors. There are as many pivots as cells of ``per_cell`` vectors need, from 16 to ``most_cells`` (the
        bound of what the driver holds); they are the vectors of the smallest hashes."""
        spark = vectors.sparkSession
        ship(spark)
        good = usable(vectors, item_id, vec)
        n = good.count()
        k = int(min(most_cells, max(16, n // per_cell)))
        # Copies make poor pivots: distinct vectors only.
        found = good.select(F.col(vec).cast("array<double>").alias("v")).groupBy(F.xxhash64("v").alias("h")).agg(F.first("v").alias("v")).orderBy("h").limit(k).collect()
        width = len(found[0]["v"]) if found else 0
        pivots = np.array([r["v"] for r in found if len(r["v"]) == width], np.float64)
        pivots = pivots.reshape(len(pivots), width)
        good = good.filter(F.size(vec) == width) if width else good.filter(F.lit(False))
        at = good.columns.index(vec)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(at))
                cell, away = np.empty(len(x), np.int32), np.empty(len(x))
                step = max(1, PAIRS // max(1, len(pivots)))
                for low in range(0, len(x), step):
                    part = x[low : low + step]
                    cell[low : low + step] = _distances(part, pivots).argmin(1)
                    away[low : low + step] = np.sqrt(((part - pivots[cell[low : low + step]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell_", "away_"])

        placed = materialize(good.mapInArrow(run, StructType([*good.schema.fields, StructField("cell_", IntegerType()), StructField("away_", DoubleType())])), "cells")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        placed.repartition(parts, "cell_", F.pmod(F.xxhash64(item_id), F.lit(8))).write.partitionBy("cell_").parquet(f"{path}/vectors")
        placed.groupBy("cell_").agg(F.min("away_").alias("near"), F.max("away_").alias("far"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>").coalesce(1).write.parquet(f"{path}/pivots")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        found = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()
        pivots = np.array([r["pivot"] for r in found], np.float64).reshape(len(found), len(found[0]["pivot"]) if found else 0)
        near, far, size = np.full(len(found), np.inf), np.full(len(found), -np.inf), np.zeros(len(found), np.int64)
        for r in spark.read.parquet(f"{path}/cells").collect():
            near[r["cell_"]], far[r["cell_"]], size[r["cell_"]] = r["near"], r["far"], r["n"]
        return cls(spark, path, pivots, near, far, size)

    def rows(self) -> DataFrame | None:
        """The stored vectors with their cells; None where nothing could be stored."""
        return self.spark.read.parquet(f"{self.path}/vectors") if len(self.pivots) else None

    def nearest(self, queries: DataFrame, k: int, item_id: str = "item_id", vec: str = "vec", same: str | None = None) -> tuple[DataFrame, dict]:
        """((query_id, item_id, distance, rank) of the k nearest by squared distance, ties by item_id; a report).

        queries: (query_id, query_vec[, same]); they are worked through in blocks of bounded bytes. With ``same`` only
        vectors that agree in that column count. The report says which share of the cells was read, and of all pairs of a
        query and a vector which share was compared.
        """
        asked = usable(queries, "query_id", "query_vec").filter(F.size("query_vec") == self.pivots.shape[1])
        asked = materialize(asked.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"), *([same] if same else [])), "queries")
        n, out, read, compared = asked.count(), None, set(), 0
        blocks = max(1, -(-n * max(1, self.pivots.shape[1]) * 8 // MOST_BYTES))
        for b in range(blocks):
            block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id", "query_vec"), F.lit(blocks)) == b)
            found, cells, pairs = self._block(block.collect(), k, item_id, vec, same, queries)
            out = found if out is None else out.unionByName(found)
            read |= cells
            compared += pairs
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", item_id))
        total = int(self.size.sum())
        report = {"cells": len(self.pivots), "cells_read": len(read) / max(1, int((self.size > 0).sum())), "pairs_compared": compared / max(1, n * total)}
        return out.withColumn("rank", rank).filter(F.col("rank") <= k), report

    def _block(self, asked: list, k: int, item_id: str, vec: str, same: str | None, queries: DataFrame) -> tuple[DataFrame, set[int], int]:
        q = np.array([r["query_vec"] for r in asked], np.float64).reshape(len(asked), self.pivots.shape[1])
        kinds = {f.name: f.dataType for f in queries.schema.fields}
        stored = self.rows()
        schema = StructType([StructField("query_id", kinds["query_id"]), StructField(item_id, stored.schema[item_id].dataType if stored is not None else kinds["query_id"]), StructField("distance", DoubleType())])
        if not len(q) or stored is None:
            return self.spark.createDataFrame([], schema), set(), 0
        away = _distances(q, self.pivots)
        slack = _slack(np.sqrt((q * q).sum(1)), np.sqrt((self.pivots**2).sum(1)), self.far[self.size > 0])
        least = np.where(self.size > 0, np.maximum(0, np.maximum(away - self.far, self.near - away)) - slack, np.inf)
        # First round: cells by distance of their pivots until they hold k vectors.
        order = np.argsort(np.where(self.size > 0, away, np.inf), axis=1)
        held = np.cumsum(self.size[order], axis=1)
        first = np.zeros_like(least, bool)
        enough = (held - self.size[order]) < k
        np.put_along_axis(first, order, enough, axis=1)
        first &= self.size > 0
        ids = [r["query_id"] for r in asked]
        labels = [r[same] for r in asked] if same else None
        start = self._compare(stored, q, ids, labels, first, None, k, item_id, vec, same, schema)
        bound = np.full(len(q), np.inf)
        place = F.row_number().over(Window.partitionBy("at").orderBy("distance"))
        for r in start.select("at", "distance").withColumn("n", place).filter(F.col("n") == k).collect():  # a number a query of this block
            bound[r["at"]] = r["distance"] ** 0.5
        visits = (least <= bound[:, None] + slack) & (self.size > 0)
        cells = set(np.flatnonzero(visits.any(0)).tolist()) | set(np.flatnonzero(first.any(0)).tolist())
        found = self._compare(stored, q, ids, labels, visits, bound + slack, k, item_id, vec, same, schema)
        return found.drop("at"), cells, int(((visits | first) * self.size).sum())

    def _compare(self, stored, q, ids, labels, visits, bound, k, item_id, vec, same, schema) -> DataFrame:  # noqa: ANN001
        """(query_id, item, distance, at): the k nearest of each query in each batch of the cells it visits."""
        cells = np.flatnonzero(visits.any(0))
        asking = {int(c): np.flatnonzero(visits[:, c]) for c in cells}
        shared = self.spark.sparkContext.broadcast((q, ids, labels, asking, bound))
        rows = stored.filter(F.col("cell_").isin([int(c) for c in cells])).select(item_id, vec, "cell_", *([same] if same else []))
        names = [f.name for f in schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ids, labels, asking, bound = shared.value
            out = to_arrow_schema(schema)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, cell = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                own = batch.column(3).to_pylist() if same else None
                at, item, far = [], [], []
                for c in np.unique(cell):
                    members = np.flatnonzero(cell == c)
                    step = max(1, PAIRS // len(members))
                    for low in range(0, len(asking[int(c)]), step):
                        who = asking[int(c)][low : low + step]
                        a, m, d = _survivors(q[who], x[members], None if bound is None else bound[who], k, [labels[w] for w in who] if same else None, [own[i] for i in members] if same else None)
                        at.append(who[a])
                        item.append(members[m])
                        far.append(d)
                at, item, far = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (at, item, far))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], out.field(0).type), batch.column(0).take(pa.array(item)), pa.array(far, pa.float64()), pa.array(at, pa.int32())], names=[*names, "at"])

        return rows.mapInArrow(run, StructType([*schema.fields, StructField("at", IntegerType())]))


def _survivors(q: np.ndarray, x: np.ndarray, bound: np.ndarray | None, k: int, labels: list | None, own: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, squared distance) of the pairs that may be among a query's k nearest: products sift, differences decide."""
    d = _distances(q, x)
    if labels is not None:
        codes: dict = {}
        a, b = (np.array([codes.setdefault(v, len(codes)) if v is not None else -1 - i for v in vs]) for i, vs in enumerate((labels, own)))
        d = np.where(a[:, None] == b[None], d, np.inf)
    limit = np.full(len(q), np.inf) if bound is None else bound
    if x.shape[0] > k:
        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
    slack = _slack(np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)))
    at, item = np.nonzero((d <= limit[:, None] + 2 * slack) & np.isfinite(d))
    far = np.empty(len(at))
    for low in range(0, len(at), 1 << 16):
        part = slice(low, low + (1 << 16))
        far[part] = ((x[item[part]] - q[at[part]]) ** 2).sum(1)
    return at, item, far
