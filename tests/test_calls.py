"""Calls in flight, the log of replies, and replies that used to fail a job."""

import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evalloom.operators import calls, models


def counting(folder, slow=0.0, fail=()):
    """A client that leaves a file a call; some prompts fail."""

    def make():
        def client(prompt):
            import os
            import time
            import uuid

            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            time.sleep(slow)
            if prompt in fail:
                raise ValueError("no answer")
            return prompt.upper()

        return client

    return make


def made(folder):
    return sorted(p.read_text() for p in folder.glob("*")) if folder.exists() else []


def test_each_prompt_is_called_once_and_its_reply_kept(spark, tmp_path):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", None, "c", "", "é\n"])], "id long, prompt string").repartition(3)
    log = f"file://{tmp_path}/log"
    got = calls.call_model_once(rows, "prompt", counting(str(tmp_path / "calls"), fail=("c",)), log, buckets=4).collect()
    assert {(r.id, r.reply, r.status) for r in got} == {(0, "A", "ok"), (1, "B", "ok"), (2, "A", "ok"), (3, None, "skipped"), (4, None, "error"), (5, "", "ok"), (6, "É\n", "ok")}
    assert [r.error for r in got if r.id == 4] == ["ValueError: no answer"]
    assert made(tmp_path / "calls") == ["", "a", "b", "c", "é\n"]
    again = calls.call_model_once(rows, "prompt", counting(str(tmp_path / "calls2")), log, buckets=4)
    assert {(r.id, r.reply) for r in again.collect()} == {(0, "A"), (1, "B"), (2, "A"), (3, None), (4, "C"), (5, ""), (6, "É\n")}
    assert made(tmp_path / "calls2") == ["c"]  # only what had failed


def test_a_task_that_runs_again_pays_for_nothing_twice(spark, tmp_path):
    """The stage after the calls fails; the second run finds every reply in the log."""
    rows = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    log = f"file://{tmp_path}/log"

    def broken(batches):
        for batch in batches:
            yield batch
            raise RuntimeError("lost")

    called = calls.call_model_once(rows, "prompt", counting(str(tmp_path / "calls")), log, buckets=2)
    with pytest.raises(Exception, match="lost"):
        called.mapInArrow(broken, called.schema).collect()
    before = len(made(tmp_path / "calls"))
    assert before > 0
    assert called.count() == 40 and called.filter("status = 'ok'").count() == 40
    assert made(tmp_path / "calls") == sorted({f"p{i}" for i in range(40)})


def test_half_a_line_of_a_killed_writer_is_passed_over(tmp_path):
    log = calls.ReplyLog(f"file://{tmp_path}", 3)
    log.put({"hash": "x", "reply": "1", "latency_ms": 0.0})
    (tmp_path / "bucket=3" / "other.jsonl").write_text('{"hash": "y", "rep')
    assert set(log.replies()) == {"x"} and calls.sha256_hex("a")[:4] == "ca97"


def test_calls_overlap_and_come_back_in_order():
    active, most, lock = 0, 0, threading.Lock()

    def slow(k):
        nonlocal active, most
        with lock:
            active += 1
            most = max(most, active)
        time.sleep(0.3 if k % 3 else 0.5)
        with lock:
            active -= 1
        return k

    with ThreadPoolExecutor(12) as threads:
        begun = time.perf_counter()
        assert list(calls.in_order(iter(range(12)), lambda k: threads.submit(slow, k), 24)) == list(range(12))
        assert time.perf_counter() - begun < 1.2 and most == 12
        most = 0
        assert list(calls.in_order(iter(range(9)), lambda k: threads.submit(slow, k), 3)) == list(range(9)) and most <= 3


def test_replies_that_nest_deeply_or_are_no_numbers(spark):
    deep = '{"a":' * 200_000
    assert models.verdict_of(deep)[0] == "ambiguous"
    assert models.verdict_of(deep + ' {"verdict": "correct", "confidence": 0.9}')[:3] == ("correct", True, 0.9)
    assert models.verdict_of('{"verdict": "correct", "confidence": "nan"}')[2] == 0.5
    assert models.verdict_of('{"verdict": "correct", "confidence": NaN}')[2] == 0.5
    assert models.verdict_of('{"verdict": "correct", "confidence": 1e999}')[2] == 1.0
    rows = spark.createDataFrame([(deep,), (None,), (json.dumps({"verdict": "incorrect"}),)], "reply string")
    assert [r.judge_verdict for r in models.parse_verdicts(rows, "reply").collect()] == ["ambiguous", "ambiguous", "incorrect"]
