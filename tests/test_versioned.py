"""Versioned tables: touched buckets, reads as of a version, killed and racing writers, streams."""

import json
import random

import pytest

from evalloom.sources.versioned import Conflict, VersionedTable
from evalloom.streaming import incremental

SCHEMA = "case_id string, ts string, v long"


def latest(rows):
    out = {}
    for c, ts, v in rows:
        if c is not None and (c not in out or ts > out[c][0]):
            out[c] = (ts, v)
    return {(c, *x) for c, x in out.items()}


def content(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def made(spark, tmp_path):
    rows = [(f"c{k}", "2024-01-01", k) for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    t = VersionedTable(spark, str(tmp_path / "t")).create(df.schema, ["case_id"], "ts", buckets=32)
    assert content(t.read()) == set() and t.upsert(df) == 1
    return t, rows


def test_an_upsert_rewrites_the_buckets_of_its_keys_only(spark, made):
    t, rows = made
    new = [(f"c{k * 7}", "2024-01-02", -k) for k in range(10)] + [("c3", "2023-12-31", -1), ("c4", "2024-01-01", -1)]
    assert t.upsert(spark.createDataFrame(new[:10], SCHEMA)) == 2 and 1 <= t.changed_buckets(2) <= 10
    assert t.upsert(spark.createDataFrame(new[10:], SCHEMA)) == 3 and t.changed_buckets(3) <= 2
    assert content(t.read()) == latest(rows + new) and content(t.read(1)) == latest(rows) and content(t.read(2)) == latest(rows + new[:10])
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == 3
    with pytest.raises(ValueError):
        t.read(9)


def test_order_ties_rows_without_key_and_deletes(spark, made):
    t, rows = made
    df = spark.createDataFrame([("n", "2024", 2, 5), ("n", "2024", 1, 4), (None, "2024", 7, 1), (None, "2024", 7, 2)], SCHEMA + ", line long")
    t.upsert(df, order="line")
    assert content(t.read().filter("case_id = 'n'")) == {("n", "2024", 1)} and t.read().filter("case_id is null").count() == 2
    version = t.delete(spark.createDataFrame([("c1",), ("c2",), ("absent",)], "case_id string"))
    assert t.read().filter("case_id in ('c1', 'c2')").count() == 0 and t.changed_buckets(version) <= 2
    assert t.read(1).count() == 500


def test_killed_and_racing_writers(spark, made, tmp_path, monkeypatch):
    t, rows = made

    def killed(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(t, "_write", killed)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(spark.createDataFrame([("c1", "2025", 0)], SCHEMA))
    assert content(t.read()) == latest(rows) and t.versions() == [0, 1]
    (tmp_path / "t" / "manifests" / "2.json").write_text('{"version": 2, "buck')  # a writer that died while it published
    assert t.versions() == [0, 1] and content(t.read()) == latest(rows)
    assert t.upsert(spark.createDataFrame([("c1", "2025", 0)], SCHEMA)) == 3
    with pytest.raises(Conflict):
        t._write(t._current(3))
    assert json.loads((tmp_path / "t" / "manifests" / "3.json").read_text())["version"] == 3


def test_expired_versions_free_their_runs(spark, made, tmp_path):
    t, rows = made
    for k in range(3):
        t.upsert(spark.createDataFrame([(f"c{j}", f"2025-0{k + 1}", k) for j in range(500)], SCHEMA))
    assert t.expire(keep=2) == 2 and t.versions() == [3, 4]
    assert {v for _, _, v in content(t.read())} == {2} and {v for _, _, v in content(t.read(3))} == {1}


def test_a_stream_upserts_each_batch_once(spark, tmp_path):
    rng, source = random.Random(2), tmp_path / "in"
    source.mkdir()
    every = []
    for k in range(3):
        rows = [(f"c{rng.randrange(30)}", f"2024-01-{rng.randint(10, 28)}T{k}{len(every) + j:05}", j) for j in range(40)]
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("case_id", "ts", "v"), r))) for r in rows))
        every += rows
        stream = incremental.stream_files(spark, SCHEMA, str(source), files_per_trigger=1)
        incremental.upsert_latest(stream, ["case_id"], "ts", str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert content(t.read()) == latest(every)
    n = t.versions()
    assert t.upsert(spark.createDataFrame([("c1", "2099", 0)], SCHEMA), batch=(str(tmp_path / "ck"), 2)) == n[-1] and t.versions() == n
