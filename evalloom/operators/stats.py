"""Aggregates of run logs: plain groupBy aggregates with partial sums; exact ranks come from ``ranks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.ranks import MEDIAN, RANKS, exact_ranks, joined, linear, linear_of, median_of


def medians(rows: DataFrame, by: list[str], value: str, name: str, places: int) -> DataFrame:
    """The rounded median of each group that has values."""
    return exact_ranks(rows, by, value, MEDIAN).select(*by, F.round(median_of(), places).alias(name))


def latency_stats(rows: DataFrame, by: list[str], value: str, p95: str = "linear") -> DataFrame:
    """Count, mean, median, least, largest and 95 % point, one place each; "linear" interpolates, the others name a rank."""
    x = F.col(value)
    rows = rows.filter(x.isNotNull())
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(x), 1).alias("mean"), F.round(F.min(x), 1).alias("min"), F.round(F.max(x), 1).alias("max"))
    found = exact_ranks(rows, by, value, MEDIAN | (linear(0.95) if p95 == "linear" else {"p95_": RANKS[p95]}))
    point = linear_of(0.95) if p95 == "linear" else F.col("p95_")
    found = found.select(*by, F.round(median_of(), 1).alias("median"), F.round(point, 1).alias("p95"))
    return joined(out, by, found).select(*by, "n", "mean", "median", "min", "max", "p95")


def config_summary(rows: DataFrame, by: list[str], means: dict[str, int]) -> DataFrame:
    """n_cases and rounded means (column -> places)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_cases"), *[F.round(F.avg(F.coalesce(F.col(c), F.lit(0.0))), k).alias(f"avg_{c}") for c, k in means.items()])


def mean_where(value: Column, condition: Column) -> Column:
    """Mean over the rows that meet the condition, 0 without any."""
    return F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0))


def verdict_summary(rows: DataFrame, by: list[str], verdict: str = "judge_verdict", correct: str = "judge_correct", latency: str | None = None, model: str | None = None) -> DataFrame:
    """Counts by verdict and the accuracies built on them; ``correct`` is tri-state (null: ambiguous)."""
    v, c = F.col(verdict), F.col(correct)
    judged = v.isin("correct", "incorrect", "ambiguous")
    aggs = [F.count("*").alias("n_records"), F.count_if(judged).alias("n_judged"), F.count_if(judged & c).alias("correct"), F.count_if(judged & ~c).alias("incorrect"), F.count_if(v == "ambiguous").alias("ambiguous")]
    if model:
        aggs.append(F.first(F.nullif(F.col(model), F.lit("")), ignorenulls=True).alias("judge_model"))
    out = rows.groupBy(*by).agg(*aggs)
    if latency:
        taken = rows.select(*by, F.nullif(F.col(latency), F.lit(0.0)).alias("latency_"))
        out = joined(out, by, medians(taken, by, "latency_", "judge_latency_ms_median", 1))
    return out.withColumns(accuracies(F.col("correct"), F.col("incorrect"), F.col("ambiguous"), F.col("n_judged")))


def accuracies(c: Column, i: Column, a: Column, n: Column) -> dict[str, Column]:
    exact = F.try_divide(c, c + i)
    rejected = F.try_divide(a, n)
    return {
        "acc_inclusive": F.round(F.try_divide(c, n), 4),
        "accuracy_excl_ambig": F.round(exact, 4),
        "rejection_rate": F.round(rejected, 4),
        "composite": F.round(exact * (1 - rejected), 4),
    }


def per_task(rows: DataFrame, by: str, task: str, correct: str, tasks: list[str]) -> DataFrame:
    """Accuracy matrix; the tasks are named, so no pass is spent on finding them."""
    return rows.groupBy(by).pivot(task, tasks).agg(F.round(F.avg(F.col(correct).cast("double")), 4))


def token_savings(rows: DataFrame, by: str, origin: str, used: str, baseline: str) -> DataFrame:
    """Token totals and percentages saved, against the own original size and against the baseline configuration."""
    t = rows.groupBy(by).agg(F.sum(origin).alias("origin_tokens"), F.sum(used).alias("input_tokens"))
    base = F.max(F.when(F.col(by) == baseline, F.col("input_tokens"))).over(Window.partitionBy())
    saved = lambda a, b: F.round(100 * (1 - F.try_divide(a, b)), 2)
    # the window runs over one row a configuration
    return t.select(by, "origin_tokens", "input_tokens", saved(F.col("input_tokens"), F.col("origin_tokens")).alias("pct_saved_vs_origin"), saved(F.col("input_tokens"), base).alias("pct_saved_vs_baseline"))


def token_stats(rows: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """Median of whole tokens (rounded down), 95 % point by rank and largest."""
    found = exact_ranks(rows, by, tokens, MEDIAN | {"p95": RANKS["floor_minus1"]})
    whole = F.floor((F.floor("median_low_") + F.floor("median_high_")) / 2).cast("long")
    out = rows.filter(F.col(tokens).isNotNull()).groupBy(*by).agg(F.max(tokens).alias("max"))
    return joined(out, by, found.select(*by, whole.alias("median"), "p95")).select(*by, "median", "p95", "max")


def ratio_stats(rows: DataFrame, by: list[str], ratio: str) -> DataFrame:
    """Median, least and largest ratio, four places; zero counts as missing. A group without ratios has nulls."""
    rows = rows.select(*by, F.nullif(F.col(ratio), F.lit(0.0)).alias("ratio_"))
    out = rows.groupBy(*by).agg(F.round(F.min("ratio_"), 4).alias("min_ratio"), F.round(F.max("ratio_"), 4).alias("max_ratio"))
    return joined(out, by, medians(rows, by, "ratio_", "median_ratio", 4)).select(*by, "median_ratio", "min_ratio", "max_ratio")


def provider_summary(rows: DataFrame, by: str, blocks: str, confidence: str, latency: str, error: str) -> DataFrame:
    """Cases, valid cases, and means over the valid ones (0 without any)."""
    valid = F.coalesce(F.col(error), F.lit("")) == ""
    n = F.greatest(F.count_if(valid), F.lit(1))
    mean = lambda c, k: F.round(F.coalesce(F.sum(F.when(valid, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0)) / n, k)
    return rows.groupBy(by).agg(F.count("*").alias("n_cases"), F.count_if(valid).alias("n_valid"), mean(blocks, 2).alias("avg_blocks"), mean(confidence, 4).alias("avg_confidence"), mean(latency, 1).alias("avg_latency_ms"))


def best_provider(rows: DataFrame, by: str, f1: str, latency: str) -> DataFrame:
    """Mean F1 over rows with one above 0, mean latency; the largest F1 wins, ties the lower latency."""
    s = rows.groupBy(by).agg(F.round(mean_where(F.col(f1), F.col(f1) > 0), 4).alias("avg_f1"), F.round(F.avg(latency), 1).alias("avg_latency_ms"))
    return s.orderBy(F.desc("avg_f1"), F.asc("avg_latency_ms"), F.asc(by)).limit(1)


def inspect(rows: DataFrame, line: str) -> DataFrame:
    """Per (track, config) of one case: n, mean cost and latency; deployment_id of the track's first row."""
    first = rows.groupBy("track").agg(F.min_by("deployment_id", line).alias("deployment_id"))
    s = rows.groupBy("track", "config").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("avg_cost_usd"), F.round(F.avg(F.coalesce("latency_ms", F.lit(0.0))), 1).alias("avg_latency_ms"))
    return s.join(first, "track")


def micro_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro precision, recall and F1 from summed tp, fp, fn."""
    s = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return s.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 4)})


def tradeoff(cost: DataFrame, latency: DataFrame, accuracy: DataFrame, by: str) -> DataFrame:
    return cost.join(latency, by).join(accuracy, by)


def time_range(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def bootstrap_interval(pairs: DataFrame, delta: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Mean paired difference with a 95 % Poisson bootstrap interval.

    Each row explodes into its non-zero weights of each round on the map side and meets the others in partial sums: what is
    shuffled is one row a task and round. Weights follow from a hash of the row's key, so reruns agree.
    """
    # Upper ends of the Poisson(1) distribution.
    ends = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)
    u = (F.pmod(F.xxhash64("key", "b", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    weight = sum((F.when(u > e, 1).otherwise(0) for e in ends), F.lit(0))
    drawn = pairs.select("key", F.col(delta).cast("double").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b")).withColumn("w", weight)
    means = drawn.groupBy("b").agg(F.try_divide(F.sum(F.col("d") * F.col("w")), F.sum("w")).alias("m"))
    interval = means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("ci_low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("ci_high"))
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(delta), 6).alias("mean_delta")).join(F.broadcast(interval), F.lit(True))


def macro_by_field(hits: DataFrame, field: str) -> DataFrame:
    """F1 of each field from its tp, fp, fn; the macro F1 is their mean."""
    return micro_scores(hits, [field])


def effective_cost(tokens: Column, cached: Column, rate: Column, discount: float) -> Column:
    """Cost where cached tokens are charged at a discount, per million."""
    return F.round(((tokens - cached) + cached * (1 - discount)) / 1e6 * rate, 8)


def macro_f1(hits: DataFrame, field: str, by: list[str] | None = None) -> DataFrame:
    """Macro F1: the plain mean of the F1 of all fields, of each group of ``by``."""
    per = micro_scores(hits, [*(by or []), field])
    return per.groupBy(*(by or [])).agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.count("*").alias("n_fields"))


def verdict_shares(rows: DataFrame, by: list[str], verdict: str = "judge_verdict") -> DataFrame:
    """Percentages of correct, incorrect and ambiguous verdicts of each group, two places (0 without any)."""
    names = ("correct", "incorrect", "ambiguous")
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(verdict) == v).alias(v) for v in names])
    return counted.withColumns({f"pct_{v}": F.round(100 * F.col(v) / F.greatest(F.col("n"), F.lit(1)), 2) for v in names})


def throughput(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Rows a minute between a group's first and last time (null where these are the same)."""
    seconds = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(60 * F.count("*") / F.nullif(seconds, F.lit(0.0)), 4).alias("per_minute"))


def end_to_end(compress_ms: Column, llm_ms: Column) -> Column:
    """Latency of a call with its compression; a missing part counts 0."""
    return F.coalesce(compress_ms, F.lit(0.0)) + F.coalesce(llm_ms, F.lit(0.0))
