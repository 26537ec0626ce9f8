"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are split in halves; each half has its own codebook (k-means on a bounded sample), and the pairs of codewords
form a grid of cells. A vector visits cells in the multi-sequence order, by falling nearness of both its halves; members of
visited cells are compared by cosine in double precision. Tables of every size go this way.

How far to visit is measured, not set: a sample of vectors asks the index for

* planted partners, the vector turned by exactly the threshold angle in random directions, so that the recall is known where a
  table holds no partners at all, and for the hardest links there are;
* its true partners among all vectors, found by brute force.

Visits go as far as either kind needs for ``recall``, doubled. The codebooks grow with the table (``cell_rows`` vectors a cell,
up to ``max_codewords`` for each half: some 800 million vectors; beyond, cells grow).

Each pair of vectors is looked at from one side only (``side_of``), so a pair that is found is counted once. The rows of the
grid are gathered into bands of some ``block`` vectors. A vector is shipped once for each band that it visits, with the list of
its cells there, not once a cell; a task compares a block of a band with some of the band's guests, each guest with the cells
that it visits. A crowded band has several blocks, and every (block, guests) is a task of its own, so copies and crowded cells
spread out. A task keeps what it finds as a spanning forest and a number of links for each vector, never as pairs. Connected
components follow. Equal vectors are one node with a count. Codebooks (``max_codewords`` each at most) are broadcast; no vector
but the sample (``sample_rows``, or eight a codeword, and ``queries``) reaches the driver.

Defined results
* null, empty or zero vectors, and those with null or non-finite components: no links, their own component, kept.
* vectors of different lengths do not link; each length is searched on its own.
* ties at the threshold: a cosine equal to it in double precision links. Rows that share a vec_id are one node.
* a null vec_id: component null, not kept, unless an equal vector has an id. An empty table gives an empty result; extra
  columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import materialize
from evalloom.llm.connected import Union, components
from evalloom.session import ship


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=False)].copy()
    some = max(1, (1 << 24) // k)  # distances held at once
    for _ in range(rounds):
        near = np.concatenate([distances(x[at : at + some], centres).argmin(axis=1) for at in range(0, len(x), some)])
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        centres[~full] = x[random.choice(len(x), int((~full).sum()))]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


class MultiIndex:
    """Two codebooks and the order in which a query visits the cells of their grid."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.half = first.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, seed: int) -> MultiIndex:
        random = np.random.default_rng(seed)
        half = sample.shape[1] // 2 or 1
        a, b = sample[:, :half], sample[:, half:] if sample.shape[1] > 1 else sample
        k = max(1, min(k, len(sample)))
        return cls(k_means(a, k, random), k_means(b, k, random))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.first), distances(x[:, self.half :] if x.shape[1] > 1 else x, self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1).astype(np.int64) * len(self.second) + b.argmin(axis=1)

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` cells of each query's multi-sequence, nearest first.

        The pair of the i-th and j-th nearest codewords comes after i * j pairs that are as near, so the first ``most`` are
        among the pairs with i * j <= most; these few sums are sorted for all queries at once.
        """
        a, b = self.halves(x)
        most = min(most, a.shape[1] * b.shape[1])
        i, j = (np.array(v) for v in zip(*[(i, j) for i in range(min(most, a.shape[1])) for j in range(min(most // (i + 1), b.shape[1]))], strict=True))
        order_a, order_b = np.argsort(a, axis=1, kind="stable")[:, : i.max() + 1], np.argsort(b, axis=1, kind="stable")[:, : j.max() + 1]
        near_a, near_b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        best = np.argsort(near_a[:, i] + near_b[:, j], axis=1, kind="stable")[:, :most]
        rows = np.arange(len(x))[:, None]
        return order_a[rows, i[best]].astype(np.int64) * len(self.second) + order_b[rows, j[best]]


def visits_to(index: MultiIndex, a: np.ndarray, b: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many cells each query (its distances ``a`` and ``b`` to the codewords) visits until it has seen its cell of ``cells``."""
    i, j = np.divmod(cells, len(index.second))
    rows = np.arange(len(cells))
    reach, b = a[rows, i] + b[rows, j] + 1e-12, np.sort(b, axis=1)  # sums and differences round apart
    return np.array([np.searchsorted(near, r - far, side="right").sum() for near, far, r in zip(b, a, reach, strict=True)], np.int64)


def planted_partners(x: np.ndarray, threshold: float, random: np.random.Generator) -> np.ndarray:
    """A partner of each unit vector whose cosine with it is ``threshold``, in a random direction."""
    side = random.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    lengths = np.sqrt((side * side).sum(axis=1, keepdims=True))
    return threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * side / np.where(lengths > 0, lengths, 1)


def planted_visits(index: MultiIndex, x: np.ndarray, threshold: float, random: np.random.Generator, times: int) -> np.ndarray:
    """The visits that ``x`` needs to see its planted partners, ``times`` each."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(x), 256):
        some = x[at : at + 256]
        a, b = index.halves(some)
        out += [visits_to(index, a, b, index.cell(planted_partners(some, threshold, random))) for _ in range(times)]
    return np.concatenate(out)


def visits_needed(nodes: DataFrame, shared: Broadcast, asked: tuple[np.ndarray, np.ndarray], threshold: float, recall: float, planted: np.ndarray) -> int:
    """How many cells to visit so that ``recall`` of the planted partners and of all true partners of ``asked`` among all
    ``nodes`` are found. For true partners it holds for all pairs together and for the mean query, so crowds do not decide alone.
    """
    queries = nodes.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (ids, x) = shared.value, queries.value
        cells = len(index.first) * len(index.second)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                v = unit(_vectors(some.column(1)))
                q, m = np.nonzero(x @ v.T >= threshold)
                own = ids[q] != some.column(0).to_numpy()[m]
                if not own.any():
                    continue
                pairs, n = np.unique(q[own] * cells + index.cell(v)[m[own]], return_counts=True)
                q = pairs // cells
                for k in range(0, len(q), 256):
                    to = slice(k, k + 256)
                    a, b = index.halves(x[q[to]])
                    yield pa.RecordBatch.from_arrays([pa.array(q[to]), pa.array(visits_to(index, a, b, pairs[to] % cells)), pa.array(n[to].astype(np.int64))], names=["q", "visits", "n"])

    found = nodes.select("node", "v").mapInArrow(run, "q long, visits long, n long").groupBy("q", "visits").agg(F.sum("n").alias("n"))
    found = materialize(found, "partners")
    share = found.join(found.groupBy("q").agg(F.sum("n").alias("all")), "q")
    rows = share.groupBy("visits").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("all")).alias("part")).orderBy("visits").collect()  # a row a rank at most
    queries.unpersist()
    needed = int(np.quantile(planted, recall, method="higher")) if len(planted) else 1
    if rows:
        pairs, mean = (np.cumsum([float(r[c]) for r in rows]) for c in ("n", "part"))
        needed = max(needed, rows[np.flatnonzero((pairs >= recall * pairs[-1]) & (mean >= recall * mean[-1]))[0]]["visits"])
    return needed


def _vectors(column: pa.Array) -> np.ndarray:
    first, last = column.offsets[0].as_py(), column.offsets[-1].as_py()
    return column.values.to_numpy(zero_copy_only=False)[first:last].reshape(len(column), -1)


def _blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    return rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))


def _tasks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own = tuple(c[a] for c in columns)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, recall: float = 0.999, sample_rows: int = 20_000, max_codewords: int = 8192, cell_rows: int = 12, least_cells: int = 8, queries: int = 2000, planted: int = 5, block: int = 4096, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v"))
    infinite = float("inf")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (x == infinite) | (x == -infinite))
    usable = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    alone = rows.filter(~usable)
    nodes = materialize(rows.filter(usable).groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).filter("node is not null"), "vectors")
    none = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = None
    for width, total in sorted(tuple(r) for r in nodes.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()):
        own = _links(nodes.filter(F.size("v") == width), total, threshold, recall, sample_rows, max_codewords, cell_rows, least_cells, queries, planted, block, seed)
        own = materialize(own, "vector-links")
        found = own if found is None else found.unionByName(own)
    result = none
    if found is not None:
        groups = components(found.select("a", "b").filter("a <> b")).select(F.col("id").alias("node"), "component")
        linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        of = nodes.join(groups, "node", "left").join(linked, "node", "left")
        of = of.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
        result = rows.filter(usable).join(of, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id").unionByName(none)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


FOUND = "a long, b long, links long"


def _found(ids: np.ndarray, union: Union, links: np.ndarray) -> pa.RecordBatch:
    """(a, b, links): for each vector that has links the one that names its tree in the task's forest, and their number."""
    out = np.flatnonzero(links)
    roots = np.array([union.find(p) for p in out.tolist()], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[roots]), pa.array(links[out].astype(np.int64))], names=["a", "b", "links"])


def _links(nodes, total, threshold, recall, sample_rows, max_codewords, cell_rows, least_cells, queries, planted, block, seed) -> DataFrame:
    """FOUND rows of vectors of one length; the numbers of links of a vector's rows add up, copies of its partners counted."""
    spark = nodes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    codewords = int(np.clip(np.sqrt(total / cell_rows), 1, max_codewords))
    taught = max(sample_rows, 8 * codewords)
    drawn = nodes.select("node", "v", F.xxhash64("v", F.lit(seed)).alias("h")).orderBy("h").limit(taught + queries).select("node", "v").toArrow().combine_chunks()
    ids, sample = drawn.column(0).to_numpy(), unit(_vectors(drawn.column(1).combine_chunks()))
    # the queries are, where there are others, not those that made the codebooks: these lie nearer to their codewords
    index = MultiIndex.fit(sample[:taught], codewords, seed)
    shared = spark.sparkContext.broadcast(index)
    asked = (ids[-queries:], sample[-queries:])
    easy = planted_visits(index, asked[1], threshold, np.random.default_rng(seed), planted)
    visits = max(least_cells, 2 * visits_needed(nodes, shared, asked, threshold, recall, easy))
    size = int(np.clip((8 << 20) // (8 * sample.shape[1]), 1, block))
    rows = np.bincount(index.cell(sample) // len(index.second), minlength=len(index.first)) * (total / len(sample))
    bands = ((np.cumsum(rows) - rows / 2) // size).astype(np.int64)
    return _visited_pairs(nodes, shared, bands, min(visits, len(index.first) * len(index.second)), threshold, size, parts)


def side_of(own: np.ndarray, cells: np.ndarray, own_band: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Whether a vector at home in ``own`` looks for partners in ``cells``, rather than these for theirs in its own cell: one of
    the two always does, chosen by the parity of the bands, or inside a band of the cells, so that work and guests spread evenly.
    Members of one cell look at each other."""
    a, b = np.where(own_band == bands, own, own_band), np.where(own_band == bands, cells, bands)
    return (a == b) | ((a < b) == ((a + b) % 2 == 0))


def _connect(union: Union, i: np.ndarray, j: np.ndarray) -> None:
    """Joins all pairs (i, j): each vector with its first partner, then what these left apart."""
    for ends in (i, j):
        _, at = np.unique(ends, return_index=True)
        for a, b in zip(i[at].tolist(), j[at].tolist(), strict=True):
            union.join(a, b)
    seen, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = np.array([union.find(p) for p in seen.tolist()], np.int64)[where].reshape(2, -1)
    for p, q in np.unique(np.stack([a, b], 1)[a != b], axis=0).tolist():
        union.join(p, q)


def _placed(index: MultiIndex, bands: np.ndarray, visits: int, x: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each vector: its home cell; the bands in which it looks for partners; its cells in each of these."""
    visited = index.visits(x, visits)
    home, width = visited[:, 0], len(index.second)  # the nearest of all cells
    row, cells = np.repeat(np.arange(len(x)), visited.shape[1]), visited.ravel()
    band = bands[cells // width]
    ours = np.flatnonzero(side_of(home[row], cells, bands[home // width][row], band))
    order = ours[np.lexsort((cells[ours], band[ours], row[ours]))]
    row, cells, band = row[order], cells[order], band[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (band[1:] != band[:-1])])
    inner = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(cells)].astype(np.int32)), pa.array(cells))
    of = pa.array(np.searchsorted(row[starts], np.arange(len(x) + 1)).astype(np.int32))
    return pa.array(home), pa.ListArray.from_arrays(of, pa.array(band[starts])), pa.ListArray.from_arrays(of, inner)


def _visited_pairs(nodes: DataFrame, shared: Broadcast, bands: np.ndarray, visits: int, threshold: float, block: int, parts: int) -> DataFrame:
    """FOUND rows of the links between vectors and the members of the cells they visit; ``bands`` of the grid's rows."""
    at_once = int(np.clip((1 << 18) // visits, 1, 1024))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                some = batch.slice(at, at_once)
                home, visited, cells = _placed(shared.value, bands, visits, unit(_vectors(some.column(1))))
                band = pa.array(bands[home.to_numpy() // len(shared.value.second)])
                yield pa.RecordBatch.from_arrays([*some.columns, home, band, visited, cells], names=["node", "v", "copies", "home", "band", "visited", "cells"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _tasks(batches, 3):
            ids, side, copies, home = (task.column(c).to_numpy() for c in ("node", "side", "copies", "home"))
            x, lists = unit(_vectors(task.column("v").combine_chunks())), task.column("cells").combine_chunks()
            offsets = lists.offsets.to_numpy()
            row, cells = np.repeat(np.arange(len(x)), np.diff(offsets)), lists.values.to_numpy()[offsets[0] : offsets[-1]]
            order = np.lexsort((row, cells))
            row, cells = row[order], cells[order]
            guests, guest_cells = row[side[row] == 0], cells[side[row] == 0]
            hosts, host_cells = row[side[row] == 1], cells[side[row] == 1]
            # a vector may be guest and host here: its links and its tree are kept by its first row
            _, first, which = np.unique(ids, return_index=True, return_inverse=True)
            first = first[which]
            union, links = Union(len(x)), np.zeros(len(x))
            for cell in np.intersect1d(guest_cells, host_cells).tolist():
                g = guests[slice(*np.searchsorted(guest_cells, [cell, cell + 1]))]
                h = hosts[slice(*np.searchsorted(host_cells, [cell, cell + 1]))]
                right, some = x[h].T, max(1, (1 << 20) // len(h))
                for at in range(0, len(g), some):
                    i, j = np.nonzero(x[g[at : at + some]] @ right >= threshold)
                    i, j = g[at + i], h[j]
                    once = (home[i] != cell) | (ids[i] < ids[j])  # members of one cell look at each other
                    i, j = first[i[once]], first[j[once]]
                    if len(i):
                        links += np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
                        _connect(union, i, j)
            yield _found(ids, union, links)

    placed = nodes.select("node", "v", "copies").mapInArrow(place, "node long, v array<double>, copies long, home long, band long, visited array<long>, cells array<array<long>>")
    placed = materialize(placed, "placed")
    guests = placed.select("node", "v", "copies", "home", F.inline(F.arrays_zip(F.col("visited").alias("band"), F.col("cells").alias("cells"))).alias("band", "cells"))
    hosts = placed.select("node", "v", "copies", "home", "band", F.array("home").alias("cells"))
    joined = _pairs_of_blocks(guests, hosts, "band", 4 * block, block)
    columns = ["band", "gb", "mb", "side", "node", "copies", "home", "cells", "v"]
    return joined.repartition(parts, "band", "gb", "mb").sortWithinPartitions("band", "gb", "mb").select(*columns).mapInArrow(search, FOUND)


def _pairs_of_blocks(left: DataFrame, right: DataFrame, key: str, left_rows: int, right_rows: int) -> DataFrame:
    """Rows of both sides (0 and 1) for each task (key, gb, mb): a block of the left with a block of the right of one key."""
    blocks = _blocks(left, key, left_rows).withColumnRenamed("blocks", "lefts").join(_blocks(right, key, right_rows).withColumnRenamed("blocks", "rights"), key)
    blocks = materialize(blocks, "blocks")
    salt = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(blocks, key).withColumn("side", F.lit(0)).withColumn("gb", salt("lefts")).withColumn("mb", every("rights"))
    b = right.join(blocks, key).withColumn("side", F.lit(1)).withColumn("mb", salt("rights")).withColumn("gb", every("lefts"))
    columns = [*left.columns, "side", "gb", "mb"]
    return a.select(*columns).unionByName(b.select(*columns))
