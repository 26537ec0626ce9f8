"""When to stop measuring: paired bootstrap over growing batches of cases, and the stop and continue rules built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.ranks import exact_ranks, linear, linear_of
from evalloom.session import materialize

#: Modulus of the draws; products of two numbers below it fit in 64 bits.
PRIME = (1 << 31) - 1
# Upper ends of the Poisson(1) distribution, the refusal accuracy asked for, shares of slow cases.
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)
REFUSAL, SLOW, FACTOR = 0.85, 0.10, 2.0


def _with_draw(df: DataFrame, name: str, key: Column, salt: Column) -> DataFrame:
    """Add a number below PRIME that depends on both in no simple way; whole-number arithmetic only, the same in any engine.

    A column a step, so that each is computed once.
    """
    x, low = F.col(name), F.pmod(key, F.lit(PRIME))
    df = df.withColumn(name, (low * 48271 + salt * 69621 + 12345) % PRIME)
    return df.withColumn(name, (x * x + salt) % PRIME).withColumn(name, (x * x + low) % PRIME)


def growing_intervals(pairs: DataFrame, key: str, deltas: list[str], steps: int = 8, rounds: int = 200, seed: int = 7) -> DataFrame:
    """(delta, step, n, mean, ci_low, ci_high): 95 % Poisson bootstrap intervals of the mean of each paired difference, over
    batches of cases that double from step to step, the last one being all.

    ``key`` is a whole number. A case belongs to a batch by a hash, and its weight in a round follows from another, so reruns
    agree. Rows meet in partial sums of (step, round) on the map side: a task sends at most steps x rounds rows, and the sums
    of a batch are running sums of these.
    """
    step = F.lit(0)
    for j in range(1, steps):
        step = step + F.when(F.col("lot_") >= PRIME >> j, 1).otherwise(0)
    case = _with_draw(pairs.select(F.col(key).cast("long").alias("key_"), *[F.col(d).cast("double").alias(f"d{k}_") for k, d in enumerate(deltas)]), "lot_", F.col("key_"), F.lit(seed))
    weight = F.when(F.col("b_") < 0, 1)  # the plain mean is round -1
    weight = weight.otherwise(sum((F.when(F.col("u_") > e * PRIME, 1).otherwise(0) for e in POISSON), F.lit(0)))
    drawn = case.withColumn("step_", step).drop("lot_").withColumn("b_", F.explode(F.sequence(F.lit(-1), F.lit(rounds - 1))))
    drawn = _with_draw(drawn, "u_", F.col("key_") + 1, F.col("b_") + seed * 1000).withColumn("w_", weight)
    sums = drawn.groupBy("step_", "b_").agg(F.sum(F.when(F.col("b_") < 0, 1)).alias("n_"), *[x for k in range(len(deltas)) for x in (F.sum(F.col(f"d{k}_") * F.col("w_")).alias(f"s{k}_"), F.sum(F.when(F.col(f"d{k}_").isNotNull(), F.col("w_"))).alias(f"c{k}_"))])
    # Batches that got no case of their own still hold those of the smaller ones.
    every = pairs.sparkSession.range(steps).select(F.col("id").cast("int").alias("step_")).crossJoin(pairs.sparkSession.range(-1, rounds).select(F.col("id").cast("int").alias("b_")))
    upto = Window.partitionBy("b_").orderBy("step_")
    sums = every.join(materialize(sums, "draws"), ["step_", "b_"], "left")
    sums = sums.select("step_", "b_", *[F.sum(c).over(upto).alias(c) for c in ("n_", *[f"{x}{k}_" for k in range(len(deltas)) for x in "sc"])])
    means = sums.select("step_", "b_", "n_", F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.try_divide(f"s{k}_", f"c{k}_").alias("m")) for k, d in enumerate(deltas)])).alias("x")).select("step_", "b_", "n_", "x.*")
    drawn_mean = F.when(F.col("b_") >= 0, F.col("m"))
    return means.groupBy("delta", F.col("step_").alias("step")).agg(F.coalesce(F.max("n_"), F.lit(0)).alias("n"), F.max(F.when(F.col("b_") < 0, F.col("m"))).alias("mean"), F.percentile(drawn_mean, F.lit(0.025)).alias("ci_low"), F.percentile(drawn_mean, F.lit(0.975)).alias("ci_high"))


def separated(intervals: DataFrame, least: int = 2) -> DataFrame:
    """(delta, met, mean, n): the first batch of at least ``least`` cases whose interval leaves 0, else the last one, not met."""
    apart = (F.col("n") >= least) & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0))
    marked = intervals.withColumn("apart_", F.coalesce(apart, F.lit(False)))
    order = F.struct(~F.col("apart_"), F.when(F.col("apart_"), F.col("step")).otherwise(-F.col("step")))
    best = marked.groupBy("delta").agg(F.min_by(F.struct(F.col("apart_").alias("met"), "mean", "n"), order).alias("r"))
    return best.select("delta", "r.*")


def stop_rules(runs: DataFrame, configs: list[str], baseline: str, steps: int = 8, rounds: int = 200) -> DataFrame:
    """(rule, met, value, n): S1 to S3 say go on, C1 to C4 settle the configuration.

    ``runs``: case_id (whole number), config, quality, cost, latency_ms, refusal_ok (null where no refusal is at stake). The
    two configurations of the best mean quality (ties: cheaper, then by name) are compared case by case.

    S1 some difference of cost or quality cannot be told from 0; C1 none. S2 at least a tenth of the best one's cases take over
    twice the baseline's 95 % point; C2 under a tenth. S3 refusals are right in less than 85 %; C3 not. C4 every configuration
    has run on every case.
    """
    runs = materialize(runs.select(F.col("case_id").cast("long").alias("case_id"), F.col("config").cast("string").alias("config"), "quality", "cost", "latency_ms", "refusal_ok"), "runs")
    means = runs.groupBy("config").agg(F.round(F.avg("quality"), 9).alias("q"), F.round(F.avg("cost"), 9).alias("c"))
    top = [r["config"] for r in means.orderBy(F.desc_nulls_last("q"), F.asc_nulls_last("c"), "config").limit(2).collect()]
    one, two = (top + [None, None])[:2]
    side = lambda name, c: F.max(F.when(F.col("config") == F.lit(name), F.col(c)))
    pairs = runs.filter(F.col("config").isin([x for x in top if x is not None])).groupBy("case_id").agg((side(one, "quality") - side(two, "quality")).alias("quality"), (side(one, "cost") - side(two, "cost")).alias("cost"))
    found = separated(growing_intervals(pairs.filter("quality is not null and cost is not null"), "case_id", ["quality", "cost"], steps, rounds))
    apart = found.agg(F.coalesce(F.every("met"), F.lit(False)).alias("met"), F.max(F.when(F.col("delta") == "quality", F.col("mean"))).alias("value"), F.max("n").alias("n"))
    p95 = exact_ranks(runs.filter(F.col("config") == baseline), [], "latency_ms", linear(0.95)).select(linear_of(0.95).alias("p95"))
    own = runs.filter((F.col("config") == F.lit(one)) & F.col("latency_ms").isNotNull()).crossJoin(F.broadcast(p95))
    slow = own.agg(F.try_divide(F.count_if(F.col("latency_ms") > FACTOR * F.col("p95")), F.count("*")).alias("value"), F.count("*").alias("n"))
    right = runs.agg(F.avg(F.col("refusal_ok").cast("double")).alias("value"), F.count("refusal_ok").alias("n"))
    cases = runs.agg(F.countDistinct("case_id").alias("all"))
    ran = runs.filter(F.col("config").isin(configs)).groupBy("config").agg(F.countDistinct("case_id").alias("own")).crossJoin(F.broadcast(cases))
    full = ran.agg(F.count_if(F.col("own") == F.col("all")).cast("double").alias("value"), F.coalesce(F.sum("own"), F.lit(0)).alias("n"))
    return (
        _rules(apart, {"S1": ~F.col("met"), "C1": F.col("met")})
        .unionByName(_rules(slow, {"S2": F.col("value") >= SLOW, "C2": F.col("value") < SLOW}))
        .unionByName(_rules(right, {"S3": F.col("value") < REFUSAL, "C3": F.col("value") >= REFUSAL}))
        .unionByName(_rules(full, {"C4": F.col("value") == len(configs)}))
    )


def _rules(one: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, met, value, n) for each rule that one row decides; what was not measured is not met."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(met, F.lit(False)).alias("met")) for name, met in rules.items()])
    return one.select(F.explode(each).alias("r"), F.col("value").cast("double").alias("value"), F.col("n").cast("long").alias("n")).select("r.*", "value", "n")
