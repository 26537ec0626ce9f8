"""Connected components of an edge table: stars inside each task first, then alternating large and small stars.

Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import materialize
from evalloom.session import ship


class Union:
    """Sets of small whole numbers, each named by its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _stars(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around its components' smallest ids; with ``roots`` these have a row too."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    a = [x for x in up if roots or find(x) != x]
    for at in range(0, len(a), 10_000):
        some = a[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["id", "component"] if roots else ["a", "b"])


def components(edges: DataFrame, edges_a_task: int = 200_000, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge (a, b) to another: the smallest id it is connected with.

    Each round, tasks of about ``edges_a_task`` edges turn theirs into stars; a round of one task has seen all and ends.
    While there are more, a large and a small star round link what tasks have apart. A hub's edges meet in aggregates of one
    row a task and in joins that Spark can split, never in one list. Loops and repeated edges do no harm; a null end drops
    the edge.
    """
    ship(edges.sparkSession)
    plain = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    now = materialize(plain, "edges")
    before = None
    for _ in range(most_rounds):
        tasks = max(1, -(-now.count() // edges_a_task))
        dealt = now.coalesce(tasks) if now.rdd.getNumPartitions() >= tasks else now.repartition(tasks)
        if tasks == 1:
            return materialize(dealt.mapInArrow(partial(_stars, roots=True), "id long, component long"), "components")
        now = materialize(dealt.mapInArrow(_stars, "a long, b long"), "stars")
        now = materialize(_small_star(_large_star(now)), "stars")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == before:
            break
        before = found
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    linked = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return others.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
