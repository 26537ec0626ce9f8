"""Line numbers of split files against a sequential read."""

import gzip
import json
import random

import pytest

from evalloom.operators import logs, stats
from evalloom.sources import ordered, readers

RECORD = "case_id string, ts string, track string, config string, v long, cost_usd double, latency_ms double, deployment_id string"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three files, one of them empty, one with long lines, line ends of both kinds, blank and broken lines, two summaries."""
    rng, out = random.Random(3), tmp_path_factory.mktemp("logs")
    every = []
    for name, n, end in (("a.jsonl", 400, "\n"), ("b.jsonl", 0, "\n"), ("c.jsonl", 150, "\r\n")):
        lines = []
        for k in range(n):
            lines.append(json.dumps({"case_id": f"c{rng.randrange(40)}", "ts": f"2024-01-0{rng.randint(1, 3)}", "track": rng.choice("xy"), "config": rng.choice("AB"), "v": k, "cost_usd": 0.5, "latency_ms": 2.0, "deployment_id": name + str(k)}))
            if k % 50 == 7:
                lines += [rng.choice(["", "   ", "{broken", '{"v": "' + "x" * 900 + '"}', "[1]"])]
            if n == 400 and k in (120, 333):
                lines.append(json.dumps({"SUMMARY": {"n": k}}))
        (out / name).write_bytes((end.join(lines) + (end if n == 400 else "")).encode())
        every.append((name, lines))
    return out, every


@pytest.fixture(params=[300, 5000, 1 << 27])
def split(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(request.param))
    yield request.param
    for n, b in zip(names, before):
        spark.conf.set(n, b)


def parsed(every):
    out, place = [], 0
    for name, lines in every:
        for k, line in enumerate(lines, 1):
            try:
                row = json.loads(line)
            except ValueError:
                row = None
            out.append((name, k, place, line, row if isinstance(row, dict) else None))
            place += 1
    return out


def test_lines_are_numbered_as_a_sequential_read_does(spark, folder, split):
    path, every = folder
    got = sorted((r.place, r.file.rsplit("/", 1)[1], r.line, r.value) for r in ordered.numbered_lines(spark, f"{path}/*.jsonl").collect())
    assert got == [(p, name, k, line) for name, k, p, line, _ in parsed(every)]
    if split == 300:
        assert spark.read.text(f"{path}/*.jsonl").rdd.getNumPartitions() > 50


def test_first_n_first_summary_latest_and_inspect(spark, folder, split):
    path, every = folder
    rows = ordered.ordered_jsonl(spark, f"{path}/*.jsonl", RECORD)
    want = [(p, r) for _, _, p, _, r in parsed(every) if r is not None and not isinstance(r.get("v"), str)]
    assert [(r.place, r.v) for r in logs.first_rows(rows, "place", 37).collect()] == [(p, r.get("v")) for p, r in want[:37]]
    latest = {}
    for p, r in want:
        if "case_id" in r and (r["case_id"] not in latest or r["ts"] > latest[r["case_id"]][1]["ts"]):
            latest[r["case_id"]] = (p, r)
    got = logs.keep_latest(rows.filter("case_id is not null"), ["case_id"], "ts", "place").collect()
    assert {(r.case_id, r.place) for r in got} == {(c, p) for c, (p, _) in latest.items()}
    first = {}
    for _, r in want:
        if "track" in r:
            first.setdefault(r["track"], r["deployment_id"])
    assert {(r.track, r.deployment_id) for r in stats.inspect(rows.filter("track is not null"), "place").collect()} == set(first.items())
    scores, summary = ordered.scores_with_summary(spark, f"{path}/*.jsonl", RECORD)
    assert [json.loads(r.summary) for r in summary.collect()] == [{"n": 120}]
    assert scores.filter("case_id is not null").count() == 550
    assert json.loads(readers.scores_and_summary(spark, f"{path}/*.jsonl", RECORD)[1].first()[0]) == {"n": 120}


def test_bad_lines_and_cases(spark, folder, split):
    path, every = folder
    lines = ordered.numbered_lines(spark, f"{path}/*.jsonl")
    kept = ordered.records(lines, RECORD, "keep")
    broken = {p for _, _, p, line, r in parsed(every) if line.strip() and (r is None or isinstance(r.get("v"), str))}
    assert {r.place for r in kept.filter("_corrupt_record is not null").select("place").collect()} == broken and broken
    with pytest.raises(Exception, match="(?i)malformed"):
        ordered.records(lines, RECORD, "fail").collect()
    with pytest.raises(ValueError):
        ordered.records(lines, RECORD, "mend")
    one = ordered.records(lines, RECORD, case_id="c7")
    assert {r.place for r in one.collect()} == {p for *_, p, _, r in parsed(every) if r and r.get("case_id") == "c7"}


def test_escaped_ids_compressed_files_and_no_files(spark, tmp_path):
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"case_id": "\\u0063\\u0037"}\n{"case_id": "c7"}\n{"case_id": "c77"}')
    rows = ordered.ordered_jsonl(spark, str(tmp_path), "case_id string", case_id="c7")
    assert sorted((r.line, r.place) for r in rows.collect()) == [(1, 0), (2, 1)]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.jsonl").write_text("")
    assert ordered.ordered_jsonl(spark, str(tmp_path / "empty"), "eval_log").count() == 0
    assert ordered.scores_with_summary(spark, str(tmp_path / "empty"), "eval_log")[1].count() == 0
