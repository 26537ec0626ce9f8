"""Windows that open with the first hit, in batch and as a stream, against a sequential replay."""

import datetime as dt
import random

import pytest

from evalloom.operators import windows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def replay(hits, most, seconds=60):
    """[(key, seconds, id)] in order -> {id: (window start, allowed)}."""
    opened, out = {}, {}
    for key, t, i in sorted(hits, key=lambda h: (h[1], h[2])):
        start, n = opened.get(key, (None, 0))
        if start is None or t >= start + seconds:
            start, n = t, 0
        opened[key] = (start, n + 1)
        out[i] = (start, n + 1 <= most)
    return out


def hits(rng, n, span):
    out = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([rng.uniform(0, span), float(rng.randrange(int(span)))]), i) for i in range(n)]
    return [(k, round(t, 6), i) for k, t, i in out] + [("edge", 60.0 * k, n + k) for k in range(30)] + [("edge", 59.999999, n + 40)]


SCHEMA = "key string, ts timestamp, id long"


def table(spark, found):
    return spark.createDataFrame([(k, T0 + dt.timedelta(seconds=t), i) for k, t, i in found], SCHEMA)


@pytest.mark.parametrize(("n", "span", "most"), [(2500, 4000, 3), (2500, 200_000, 1), (400, 30, 5), (0, 100, 2)])
def test_windows_are_those_of_a_replay(spark, n, span, most):
    found = hits(random.Random(n + span), n, span)
    got = windows.rate_limited_from_first_hit(table(spark, found).repartition(3), "key", "ts", "id", most).collect()
    want = replay(found, most)
    start = {r.id: round((r.window_start.replace(tzinfo=dt.timezone.utc) - T0).total_seconds(), 6) for r in got}
    assert {r.id: (start[r.id], r.allowed) for r in got} == want and len(got) == len(found)


def test_chunks_of_any_size_give_the_same_windows(spark):
    found = hits(random.Random(1), 1500, 9000)
    want = {i: s for i, (s, _) in replay(found, 1).items()}
    for size in (1, 2, 200):
        got = windows.rate_limited_from_first_hit(table(spark, found), "key", "ts", "id", 1, windows=size).collect()
        assert {r.id: round((r.window_start.replace(tzinfo=dt.timezone.utc) - T0).total_seconds(), 6) for r in got} == want


def test_events_without_a_time(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", T0, 2)], SCHEMA)
    assert {(r.id, r.allowed) for r in windows.rate_limited_from_first_hit(df, "key", "ts", "id", 1).collect()} == {(1, None), (2, True)}
    assert windows.rate_limited_from_first_hit(df.filter("false"), "key", "ts", "id", 1).count() == 0


STATE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STATE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STATE)


def run_batches(spark, tmp_path, batches, make, columns):
    """Each list of rows is a file and a batch of the stream; the rows that come out."""
    source = tmp_path / "in"
    source.mkdir()
    got = []
    schema = batches[0].schema
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one"))
        (next((tmp_path / "one").glob("part*.parquet"))).rename(source / f"{k}.parquet")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = make(stream).writeStream.foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.select(*columns).collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    return got


def test_stream_of_hits_equals_the_replay(spark, tmp_path, rocks):
    from evalloom.streaming import incremental

    rng = random.Random(8)
    found = [(rng.choice(["hot", "hot", "a"]), round(rng.uniform(0, 900), 3), i) for i in range(300)]
    arriving = sorted(found, key=lambda h: h[1] + rng.uniform(0, 200))  # up to 200 s late
    batches = [arriving[:100], arriving[100:200], arriving[200:], [("end", 9000.0, 9999)], [("end", 9001.0, 10000)]]
    make = lambda s: incremental.rate_from_first_hit(s, "key", "ts", "id", 3, late="600 seconds")
    got = run_batches(spark, tmp_path, [table(spark, b) for b in batches], make, ["place", "window_start", "allowed"])
    base = T0.timestamp()
    assert {p: (round(w / 1e6 - base, 3), a) for p, w, a in got} == replay(found, 3) and len(got) == len(found)


def test_expiring_values(spark, tmp_path, rocks):
    from evalloom.streaming import incremental

    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "key string, op string, value string, ts timestamp, place long, ttl_s double"
    one = [("k", "get", None, at(0), 0, None), ("k", "put", "1", at(1), 1, 10.0), ("k", "get", None, at(2), 2, None), ("e", "put", "x", at(1), 3, None)]
    two = [("k", "get", None, at(10.9), 4, None), ("k", "get", None, at(11), 5, None), ("e", "get", None, at(5000), 6, None), ("e", "delete", None, at(5001), 7, None), ("e", "get", None, at(5002), 8, None)]
    got = run_batches(spark, tmp_path, [spark.createDataFrame(b, schema) for b in (one, two)], incremental.expiring_values, ["key", "place", "value"])
    assert sorted(got) == [("e", 6, "x"), ("e", 8, None), ("k", 0, None), ("k", 2, "1"), ("k", 4, "1"), ("k", 5, None)]


def test_unfinished_cases_of_a_stream(spark, tmp_path):
    from evalloom.streaming import incremental

    done = spark.createDataFrame([("a",)], "key string")
    got = run_batches(spark, tmp_path, [table(spark, [("a", 0.0, 1), ("b", 0.0, 2)])], lambda s: incremental.unfinished(s, done, ["key"]), ["id"])
    assert got == [(2,)]
