"""Exact ranks and hash samples of groups against plain sorts, with hot groups, ties, nulls and few values."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from evalloom.operators import ranks, sampling, stats

QUARTERS = {f"q{k}": (k / 4, lambda n, k=k: F.floor(k * n / 4) + 1) for k in (1, 2, 3)}


def groups(rng):
    out = {"hot": [rng.gauss(0, 1) for _ in range(60_000)], "ties": [rng.choice([1.0, 1.0, 1.0, 2.0]) for _ in range(5000)], "one": [7.5], "two": [3.0, 1.0]}
    out |= {None: [float(k) for k in range(101)], "skew": [2.0 ** rng.randint(0, 60) for _ in range(3000)], "nan": [1.0, 2.0, float("nan")], "equal": [4.0] * 2000}
    return out


@pytest.fixture(scope="module")
def table(spark):
    found = groups(random.Random(5))
    rows = [(g, x) for g, xs in found.items() for x in xs] + [("hot", None), ("empty", None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, x double").repartition(5).cache(), found


@pytest.mark.parametrize("sketch", [(0.0025, 10_000), (0.0001, 20), (0.2, 2)])
def test_ranks_are_those_of_a_sort_whatever_the_sketch_says(table, monkeypatch, sketch):
    monkeypatch.setattr(ranks, "HALF", sketch[0])
    monkeypatch.setattr(ranks, "ACCURACY", sketch[1])
    df, found = table
    got = {r["g"]: r for r in ranks.exact_ranks(df, ["g"], "x", QUARTERS | {"low": (0.0, lambda n: F.lit(0)), "high": (0.95, lambda n: n + 5), "p": ranks.RANKS["floor"]}).collect()}
    assert set(got) == set(found)
    for g, xs in found.items():
        xs = sorted(xs, key=lambda x: (x != x, x))  # NaN last
        n = len(xs)
        want = [xs[min(n - 1, k * n // 4)] for k in (1, 2, 3)] + [xs[0], xs[-1], xs[min(n - 1, int(0.95 * n))]]
        assert str([got[g][c] for c in ("q1", "q2", "q3", "low", "high", "p")]) == str(want) and got[g]["n_"] == n, g


def test_ranks_without_groups_and_of_an_empty_table(table):
    df, found = table
    every = sorted(x for xs in found.values() for x in xs if x == x)
    r = ranks.exact_ranks(df.filter(~F.isnan("x")), [], "x", ranks.MEDIAN).collect()
    assert len(r) == 1 and (r[0]["median_low_"] + r[0]["median_high_"]) / 2 == statistics.median(every)
    assert ranks.exact_ranks(df.filter("false"), ["g"], "x", QUARTERS).count() == 0


def test_only_the_range_of_a_rank_is_sorted(spark):
    """Of a hot group, the last window sees less than a thousandth of the values."""
    df = spark.range(400_000).select(F.lit("hot").alias("g"), F.rand(3).alias("x"))
    assert 0 < ranks.values_near(df, ["g"], "x", {"p": ranks.RANKS["floor"]}).count() < 400


def plain_stratified(rows, target, strata=4, seed=42):
    import hashlib

    md5 = lambda i, s: hashlib.md5(f"{i}-{s}".encode()).hexdigest()
    out = []
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        v = sorted(r[2] or 0 for r in own)
        b = [v[len(v) // 4], v[len(v) // 2], v[3 * len(v) // 4]]
        stratum = lambda r: next((k for k in range(3) if (r[2] or 0) <= b[k]), 3)
        taken = []
        for k in range(strata):
            taken += sorted((r for r in own if stratum(r) == k), key=lambda r: (md5(r[0], seed), r[0]))[: max(1, target // strata)]
        rest = sorted((r for r in own if r not in taken), key=lambda r: (md5(r[0], seed + 1), r[0]))
        out += [(r[0], g, stratum(r)) for r in taken + rest[: max(0, target - len(taken))]]
    return sorted(out, key=str)


@pytest.mark.parametrize("target", [1, 9, 40, 5000])
def test_stratified_draws(spark, target):
    rng = random.Random(target)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 1, 1, rng.randint(0, 500)])) for i in range(4000)] + [(9000, "tiny", 3)]
    df = spark.createDataFrame(rows, "id long, task string, length long").repartition(4)
    got = sampling.stratified(df, ["task"], "length", "id", target).select("id", "task", "stratum_idx").collect()
    assert sorted(map(tuple, got), key=str) == plain_stratified(rows, target)


def test_a_draw_shuffles_a_bounded_part(spark):
    df = spark.range(100_000).select("id", F.lit("hot").alias("task"), (F.col("id") % 997).alias("length"))
    few = ranks.bottom_candidates(df.withColumn("d", sampling.seeded(F.col("id"), 1)), [(["task"], "d", 50)])
    assert 50 <= few.count() <= 300
    copies = df.withColumn("id", F.lit(3)).withColumn("d", sampling.seeded(F.col("id"), 1))
    assert sampling.stratified(copies.drop("d"), ["task"], "length", "id", 8).count() == 8
    assert sampling.quotas(200, 7) == 28 and sampling.quotas(3, 7) == 1


def test_medians_and_ratios(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 4.0), ("b", 0.0), (None, 1.5)], "g string, r double")
    assert {tuple(r) for r in stats.ratio_stats(df, ["g"], "r").collect()} == {("a", 3.0, 2.0, 4.0), ("b", None, None, None), (None, 1.5, 1.5, 1.5)}
    rows = df.withColumns({"judge_verdict": F.lit("correct"), "judge_correct": F.lit(True)})
    assert {(r["g"], r["judge_latency_ms_median"]) for r in stats.verdict_summary(rows, ["g"], latency="r").collect()} == {("a", 3.0), ("b", None), (None, 1.5)}
