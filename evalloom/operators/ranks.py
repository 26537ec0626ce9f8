"""Exact order statistics and hash samples of groups of any size: no group is sorted, gathered or numbered as a whole.

``exact_ranks`` selects by ranges. A mergeable sketch gives splitters around each wanted rank of a group; one pass counts the
values of each (group, range), with partial counts on the map side; a running sum over these few counts finds the range that
holds the rank; and only the values of that range, some 1/3000 of a group, are counted by value and summed up. The sketch
decides where ranges end, never what is counted: results are exact however far off it is.

``bottom_candidates`` finds the rows of the smallest hashes of each group the same way, over powers of two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.session import materialize

#: Half the width of the band of splitters around a rank, their number in it, and the error (1/ACCURACY) of the sketch.
HALF, POINTS, ACCURACY = 0.0025, 16, 10_000

#: A wanted rank: about which fraction of a group it lies, and the rank (from 1) among n values.
Rank = tuple[float, Callable[[Column], Column]]

#: Ranks of a 95 % point among n values.
RANKS: dict[str, Rank] = {
    "floor": (0.95, lambda n: F.floor(0.95 * n) + 1),
    "floor_minus1": (0.95, lambda n: F.floor(0.95 * n)),
}


def _equal(left: list[str], right: list[str]) -> Column:
    """Group keys are equal, nulls too; without keys, always."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _renamed(df: DataFrame, keys: list[str], prefix: str) -> tuple[DataFrame, list[str]]:
    names = {k: f"{prefix}{k}" for k in keys}
    return df.withColumnsRenamed(names), list(names.values())


def values_near(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """(by0_, by1_, ..., n_, name, before, rank, x_, c_): the distinct values, and their counts, of the range that holds the
    rank of each name in each group; ``before`` values of the group are smaller than this range."""
    keys = [f"by{k}_" for k in range(len(by))]
    x = rows.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("x_"))
    fractions = sorted({f for f, _ in ranks.values()})
    grid = [min(1.0, max(0.0, f - HALF + 2 * HALF * k / POINTS)) for f in fractions for k in range(POINTS + 1)]
    points = F.expr(f"percentile_approx(x_, array({', '.join(f'{p:.12f}D' for p in grid)}), {ACCURACY})")
    sketch, own = _renamed(materialize(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), points.alias("points_")), "splitters"), keys, "own_")
    # A value's range: how many splitters of a rank's band are below it, -1 and POINTS + 1 outside.
    low = lambda k: k * (POINTS + 1)
    ranges = [f"CASE WHEN x_ < points_[{low(k)}] THEN -1 WHEN x_ > points_[{low(k) + POINTS}] THEN {POINTS + 1} ELSE size(filter(slice(points_, {low(k) + 1}, {POINTS + 1}), p -> p < x_)) END" for k in range(len(fractions))]
    counts = x.join(sketch, _equal(keys, own)).groupBy(*keys, "n_", "points_", *[F.expr(r).alias(f"range{k}_") for k, r in enumerate(ranges)]).agg(F.count(F.lit(1)).alias("c_"))
    # One row a group: its few counts, and for each rank the range that holds it with what lies before.
    lists = counts.groupBy(*keys, "n_", "points_").agg(F.collect_list(F.struct("c_", *[f"range{k}_" for k in range(len(fractions))])).alias("counts_"))
    places = {name: F.least("n_", F.greatest(F.lit(1), rank(F.col("n_")))).cast("long").alias(f"rank_{name}") for name, (_, rank) in ranks.items()}
    lists = lists.select("*", *places.values())
    held = []
    for name, (f, _) in ranks.items():
        own_range = f"range{fractions.index(f)}_"
        upto = lambda sign, to: f"aggregate(filter(counts_, d -> d.{own_range} {sign} {to}), 0L, (s, d) -> s + d.c_)"  # noqa: B023, E731
        holding = f"array_min(transform(filter(counts_, e -> {upto('<=', 'e.' + own_range)} >= rank_{name}), e -> e.{own_range}))"
        held.append(F.expr(f"named_struct('range', {holding}, 'before', {upto('<', holding)}, 'rank', rank_{name})").alias(f"at_{name}"))
    held, own = _renamed(materialize(lists.select(*keys, "n_", "points_", *held), "ranges"), keys, "own_")
    found = [f"CASE WHEN {ranges[fractions.index(f)]} = at_{name}.range THEN named_struct('name', '{name}', 'before', at_{name}.before, 'rank', at_{name}.rank) END" for name, (f, _) in ranks.items()]
    few = x.join(held, _equal(keys, own)).select(*keys, "n_", "x_", F.expr(f"explode(filter(array({', '.join(found)}), w -> w IS NOT NULL)) AS w"))
    return few.groupBy(*keys, "n_", "w.name", "w.before", "w.rank", "x_").agg(F.count(F.lit(1)).alias("c_"))


def exact_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """(by, n_, and for each name the value at its rank) of each group; null values are left out, ranks outside 1..n clipped.

    ``rows`` is read three times; what is written in between is a row a group, joined back by broadcast where its size allows.
    """
    keys = [f"by{k}_" for k in range(len(by))]
    few = values_near(rows, by, value, ranks)
    upto = F.col("before") + F.sum("c_").over(Window.partitionBy(*keys, "name").orderBy("x_"))
    hit = few.withColumn("upto_", upto).filter(F.col("upto_") >= F.col("rank"))
    out = hit.groupBy(*keys, "n_").agg(*[F.min(F.when(F.col("name") == name, F.col("x_"))).alias(name) for name in ranks])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "n_", *ranks)


MEDIAN: dict[str, Rank] = {"median_low_": (0.5, lambda n: F.floor((n + 1) / 2)), "median_high_": (0.5, lambda n: F.floor(n / 2) + 1)}


def median_of(low: str = "median_low_", high: str = "median_high_") -> Column:
    return (F.col(low).cast("double") + F.col(high).cast("double")) / 2


def linear(fraction: float) -> dict[str, Rank]:
    """The two ranks between which a percentile is interpolated."""
    return {"linear_low_": (fraction, lambda n: F.floor((n - 1) * fraction) + 1), "linear_high_": (fraction, lambda n: F.ceil((n - 1) * fraction) + 1)}


def linear_of(fraction: float) -> Column:
    at = (F.col("n_") - 1) * fraction
    low, high = F.col("linear_low_").cast("double"), F.col("linear_high_").cast("double")
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def joined(summary: DataFrame, by: list[str], found: DataFrame) -> DataFrame:
    """A table of one row a group with the columns of another such table; null keys meet."""
    found, theirs = _renamed(found, by, "rank_")
    return summary.join(found, _equal(by, theirs), "left").drop(*theirs)


def level(draw: Column) -> Column:
    """Power of two of a hexadecimal hash: a smaller hash never has a larger level, one level holds half of what is left."""
    return F.floor(F.log2(F.conv(F.substring(draw, 1, 15), 16, 10).cast("long") + 1)).cast("int")


def bottom_candidates(rows: DataFrame, wanted: list[tuple[list[str], str, int]]) -> DataFrame:
    """The rows that are among the k smallest hashes of their group for any (group columns, hash column, k), and at most
    about as many more: those of the same power of two.

    A pass counts rows by (group, level) with partial counts; a running sum over at most 61 of them gives the level that
    completes k. Copies of a row have one hash, so all of them stay or none.
    """
    keep, cuts = F.lit(False), []
    for j, (by, draw, k) in enumerate(wanted):
        counts = rows.groupBy(*by, level(F.col(draw)).alias("level_")).agg(F.count(F.lit(1)).alias("c_"))
        upto = F.sum("c_").over(Window.partitionBy(*by).orderBy("level_"))
        cut = counts.withColumn("before_", upto - F.col("c_")).filter(F.col("before_") < k).groupBy(*by).agg(F.max("level_").alias(f"cut{j}_"))
        cuts.append((by, f"cut{j}_", materialize(cut, "cuts")))
        keep = keep | (level(F.col(draw)) <= F.col(f"cut{j}_"))
    for by, _, cut in cuts:
        rows = joined(rows, by, cut)
    return rows.filter(keep).drop(*[name for _, name, _ in cuts])
