"""Stratified samples by length quartile, quotas and hash splits. Orders come from md5, so DuckDB and Spark draw alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.ranks import bottom_candidates, exact_ranks, joined


def quartile_bounds(rows: DataFrame, by: list[str], length: str) -> DataFrame:
    """(by, b1, b2, b3, n): sorted[n // 4], [n // 2], [3n // 4] of each group."""
    lengths = rows.select(*by, F.coalesce(F.col(length), F.lit(0)).alias("length_"))
    ranks = {f"b{k}": (k / 4, lambda n, k=k: F.floor(k * n / 4) + 1) for k in (1, 2, 3)}
    return exact_ranks(lengths, by, "length_", ranks).select(*by, "b1", "b2", "b3", F.col("n_").alias("n"))


def with_stratum(rows: DataFrame, by: list[str], length: str) -> DataFrame:
    bounds = quartile_bounds(rows, by, length).drop("n")
    x = F.coalesce(F.col(length), F.lit(0))
    stratum = F.when(x <= F.col("b1"), 0).when(x <= F.col("b2"), 1).when(x <= F.col("b3"), 2).otherwise(3)
    return joined(rows, by, bounds).withColumn("stratum_idx", stratum).drop("b1", "b2", "b3")


def seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary"))


def quotas(n: int, tasks: int) -> int:
    """Rows of each task where ``n`` are spread evenly over a number of tasks, one at the least."""
    return max(1, n // tasks)


def stratified(rows: DataFrame, by: list[str], length: str, key: str, target: int, seed: int = 42, strata: int = 4) -> DataFrame:
    """``target // strata`` rows of each stratum of each group, shortfalls filled from what is left of the group.

    Draws follow hashes. A counting pass finds, for each stratum and each group, the hash level that completes its quota;
    only rows below these levels are shuffled and ranked: some twice the quotas, however many rows a group has.
    """
    quota = max(1, target // strata)
    drawn = with_stratum(rows, by, length).withColumns({"draw_": seeded(F.col(key), seed), "fill_": seeded(F.col(key), seed + 1)})
    # At most quota * strata of a group's rows are drawn first, so the fill is among this many by the second hash.
    few = bottom_candidates(drawn, [([*by, "stratum_idx"], "draw_", quota), (by, "fill_", target + quota * strata)])
    ranked = few.withColumn("k_", F.row_number().over(Window.partitionBy(*by, "stratum_idx").orderBy("draw_", key)))
    first = F.col("k_") <= quota
    rest = Window.partitionBy(*by, first).orderBy("fill_", key)
    filled = ranked.withColumn("taken_", F.sum(first.cast("int")).over(Window.partitionBy(*by))).withColumn("r_", F.row_number().over(rest))
    return filled.filter(first | (F.col("r_") <= target - F.col("taken_"))).drop("draw_", "fill_", "k_", "taken_", "r_")


def split_of(key: Column, shares: dict[str, int], seed: int = 42) -> Column:
    """A named split by hash; shares in percent."""
    p = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long") % 100
    out, top = None, 0
    for name, share in shares.items():
        top += share
        out = F.when(p < top, name) if out is None else out.when(p < top, name)
    return out
