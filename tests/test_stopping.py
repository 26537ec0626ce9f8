"""Growing bootstrap intervals and the stop rules on cases whose answers are known."""

import random

from evalloom.operators import stopping


def runs(rng, n, lift=0.3, slow=0.0, right=0.9):
    out = []
    for i in range(n):
        for k, c in enumerate(("base", "good", "other")):
            quality = rng.gauss(0.5 + (lift if c == "good" else 0.0) - (0.2 if c == "other" else 0.0), 0.2)
            latency = 100.0 + rng.random() + (900 if c == "good" and rng.random() < slow else 0)
            out.append((i, c, quality, 1.0 + 0.5 * (c == "good") + 0.01 * k + rng.gauss(0, 0.1), latency, rng.random() < right if i % 2 else None))
    return out


SCHEMA = "case_id long, config string, quality double, cost double, latency_ms double, refusal_ok boolean"
CONFIGS = ["base", "good", "other"]


def rules(spark, rows, configs=CONFIGS):
    got = {r.rule: (r.met, r.value, r.n) for r in stopping.stop_rules(spark.createDataFrame(rows, SCHEMA), configs, "base").collect()}
    assert set(got) == {"S1", "S2", "S3", "C1", "C2", "C3", "C4"}
    assert all(got[f"S{k}"][0] != got[f"C{k}"][0] for k in (1, 2, 3) if got[f"S{k}"][1] is not None)
    return got


def test_clear_differences_stop_early(spark):
    got = rules(spark, runs(random.Random(1), 1500))
    assert got["C1"][0] and 0.1 < got["C1"][1] < 0.6 and got["C1"][2] < 400  # few of the 1,500 cases were needed
    assert got["C2"] == (True, 0.0, 1500) and got["C3"][0] and got["C3"][2] == 2250 and got["C4"] == (True, 3.0, 4500)


def test_no_difference_slow_cases_wrong_refusals_missing_runs(spark):
    rng = random.Random(2)
    rows = [(i, c, q, 1.0, 1000.0 if c == "a" and i % 5 == 0 else 100.0, i % 2 == 0) for i in range(300) for q in [rng.random()] for c in ("a", "base")]
    got = rules(spark, rows, ["a", "base", "never"])
    assert got["S1"][0] and got["S1"][2] == 300 and got["S1"][1] == 0.0
    assert got["S2"] == (True, 0.2, 300) and got["S3"] == (True, 0.5, 600) and got["C4"] == (False, 2.0, 600)


def test_no_runs_and_one_configuration(spark):
    got = rules(spark, [])
    assert got["S1"][0] and not any(met for rule, (met, _, _) in got.items() if rule != "S1")  # nothing measured: go on
    got = rules(spark, [r for r in runs(random.Random(3), 20) if r[1] == "base"], ["base"])
    assert got["S1"][0] and got["S1"][2] == 0 and got["C4"][0]


def test_intervals_hold_the_mean_and_narrow(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.gauss(1.0, 1.0), rng.gauss(0.0, 1.0)) for i in range(4000)], "k long, a double, b double").repartition(4)
    got = sorted(tuple(r) for r in stopping.growing_intervals(df, "k", ["a", "b"]).collect())
    assert [r[2] for r in got[:8]] == sorted(r[2] for r in got[:8]) and got[7][2] == 4000 and 10 <= got[0][2] <= 60
    for name, _, n, mean, low, high in got:
        assert low < mean < high and abs(mean - (name == "a")) < 5 / n**0.5 and 2 < (high - low) * n**0.5 < 6
