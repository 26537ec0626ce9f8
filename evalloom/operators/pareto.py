"""Pareto frontier of (cost, quality) points: lower cost and higher quality are better."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.session import materialize


def frontier(points: DataFrame, cost: str, quality: str, order: str, group: list[str] | None = None) -> DataFrame:
    """Points that none dominates, one for each pair of coordinates rounded to six places (the first by cost and ``order``).

    No point is compared with another: a first aggregate keeps the best quality of each cost, ranges of (group, cost) are
    dealt to tasks, and a running maximum inside each range on top of the largest quality of the group's ranges before it
    keeps the frontier. The table of ranges has a row for each task and group in it. Equal coordinates do not dominate each
    other.
    """
    by = group or []
    best = points.groupBy(*by, cost).agg(F.max(quality).alias("best_"))
    best = materialize(best.repartitionByRange(*by, cost).withColumn("range_", F.spark_partition_id()), "costs")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    tops = best.groupBy(*by, "range_").agg(F.max("best_").alias("top_")).withColumn("above_", F.max("top_").over(before))
    tops = tops.select(*[F.col(c).alias(f"{c}_by_") for c in by], F.col("range_").alias("range_of_"), "above_")
    same = F.col("range_") == F.col("range_of_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_by_"))
    inside = Window.partitionBy(*by, "range_").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    seen = best.join(tops, same).withColumn("seen_", F.greatest(F.max("best_").over(inside), "above_"))
    edge = seen.filter(F.col("seen_").isNull() | (F.col("best_") > F.col("seen_")))
    keys = [*by, cost]
    on = points.join(edge.select(*keys, "best_"), keys).filter(F.col(quality) == F.col("best_")).drop("best_")
    first = Window.partitionBy(*by, F.round(cost, 6), F.round(quality, 6)).orderBy(cost, order)
    return on.withColumn("k_", F.row_number().over(first)).filter("k_ = 1").drop("k_")


def frontier_by_join(points: DataFrame, cost: str, quality: str) -> DataFrame:
    """The definition itself, a non-equi anti join: for tables of a few configurations only."""
    other = points.select(F.col(cost).alias("c_"), F.col(quality).alias("q_"))
    beaten = (F.col("c_") <= F.col(cost)) & (F.col("q_") >= F.col(quality)) & ((F.col("c_") < F.col(cost)) | (F.col("q_") > F.col(quality)))
    return points.join(F.broadcast(other), beaten, "left_anti")
