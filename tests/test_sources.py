"""Readers, writers, contracts, OCR, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from evalloom.sources import documents, readers, schemas, sinks, versioned
from evalloom.streaming import incremental


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_tolerant_and_strict_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [{"case_id": "x", "question": "q"}, "", "{broken"])
    assert [r.case_id for r in readers.jsonl(spark, path, "gt_rag").collect()] == ["x"]
    assert sum(r._corrupt_record is not None for r in readers.jsonl_with_errors(spark, path, "gt_rag").collect()) == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, path, "gt_rag", tolerant=False).collect()


def test_scores_and_summary(spark, tmp_path):
    path = write(tmp_path / "s.jsonl", [{"case_id": "x", "question": "q"}, {"SUMMARY": {"n": 1}}, {"SUMMARY": {"n": 2}}])
    rows, summary = readers.scores_and_summary(spark, path, "gt_rag")
    assert rows.count() == 1 and json.loads(summary.first()[0])["n"] == 1


def test_by_stem_and_objects(spark, tmp_path):
    write(tmp_path / "hotpotqa.jsonl", [{"_id": "1"}])
    write(tmp_path / "skipme.jsonl", [{"_id": "2"}])
    write(tmp_path / "x.meta.json", [{}])
    assert [r.dataset for r in readers.by_stem(spark, f"{tmp_path}/*.jsonl", "longbench_raw", ("skipme",)).collect()] == ["hotpotqa"]
    assert readers.objects(spark, str(tmp_path), "hot").count() == 1


def test_interpolation(tmp_path):
    assert readers.interpolated("${A}/${B}", {"A": "${B}", "B": "x"}) == "x/x"
    (tmp_path / "p.yaml").write_text("a: [\"${K}\"]\n")
    assert readers.settings(str(tmp_path / "p.yaml"), {"K": "v"}) == {"a": ["v"]}
    assert readers.first_path(None, str(tmp_path)) == str(tmp_path)


def test_violations(spark):
    df = spark.createDataFrame([("x", "ocr?", -1, None)], "case_id string, ocr_provider string, page_count int, error string")
    assert {(r.column, r.problem) for r in schemas.violations(df, "ocr_result").collect()} == {("ocr_provider", "not in enumeration"), ("page_count", "below 0")}


def test_vectors(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, vec array<double>")
    path = str(tmp_path / "v")
    sinks.add_vectors(v, path)
    with pytest.raises(ValueError, match="repeated"):
        sinks.add_vectors(v, path)
    assert sinks.without(spark.read.parquet(path), v.filter("chunk_id = 'a'")).count() == 1


def test_live_keys(spark):
    rows = [("k", "1", "2024-01-01 00:00:00", 10), ("k", "2", "2024-01-01 00:00:05", 10), ("old", "x", "2024-01-01 00:00:00", 1), ("ever", "y", "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "key string, value string, ts string, ttl_s int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.key, r.value) for r in sinks.live(df, F.lit("2024-01-01 00:00:10").cast("timestamp")).collect()} == {("k", "2"), ("ever", "y")}


def test_audit_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("x", {"email": 1}, 1)], "case_id string, span_count_by_type map<string,bigint>, total bigint")
    assert sinks.audit_rows(df, "v1", "test").first().total_redactions == 1
    assert sinks.run_record(spark, "p", track="track1").first().track == "track1"
    new = sinks.new_version(df, df.withColumn("total", F.lit(5).cast("bigint")), ["case_id"], str(tmp_path / "v1"))
    assert new.first().total == 5
    sinks.overwrite_ordered(new.select("case_id"), str(tmp_path / "j"))
    sinks.append_rows(new.select("case_id"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_contracts(spark):
    c = documents.synthetic_contracts(spark, 30)
    assert c.count() == 30 and documents.contract_problems(c).count() == 0
    again = documents.synthetic_contracts(spark, 30).repartition(3)
    assert c.exceptAll(again).count() == 0
    f = c.select("ground_truth_fields.*").first()
    assert f.vin.startswith("SYNTH") and len(f.vin) == 17 and f.contract_no.startswith("SYNTH-CTR-001/")


def test_ocr_and_bake_off(spark, tmp_path):
    from evalloom.plans import tracks

    (tmp_path / "a.pdf").write_text("one\ntwo\fthree")
    (tmp_path / "b.pdf").write_bytes(b"x")

    def make():
        def engine(content):
            if content == b"x":
                raise ValueError("unreadable")
            return documents.text_engine(content)

        return engine

    r = documents.ocr(readers.objects(spark, str(tmp_path)), "tesseract", make)
    got = {x.case_id: (x.page_count, len(x.text_blocks), x.error) for x in r.collect()}
    assert got == {"a": (2, 3, None), "b": (1, 0, "ValueError: unreadable")}
    ref = spark.createDataFrame([("a", "one\ntwo\nthree")], "case_id string, text string")
    row = tracks.bake_off(r, ref).first()
    assert (row.n_cases, row.n_valid, row.avg_f1, row.avg_cer) == (2, 1, 1.0, 0.0)
    assert tracks.winner(tracks.bake_off(r, ref)).first().ocr_provider == "tesseract"
    box = spark.range(1).select(documents.box_of(F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(3.0), F.lit(2.0))))).first()[0]
    assert box == [1.0, 2.0, 3.0, 5.0]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "1.json", [{"case_id": "x", "ts": "2024-01-01T00:00:00Z", "v": 1}, {"case_id": "x", "ts": "2024-01-01T00:00:09Z", "v": 2}])
    schema = "case_id string, ts timestamp, v int"
    for _ in range(2):
        rows = incremental.stream_files(spark, schema, str(source))
        incremental.append_finished(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        incremental.upsert_latest(rows, ["case_id"], "ts", str(tmp_path / "t"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert [r.v for r in versioned.VersionedTable(spark, str(tmp_path / "t")).read().collect()] == [2]
    limited = incremental.rate_by_minute(incremental.stream_files(spark, schema, str(source)), "case_id", "ts", 1)
    q = limited.writeStream.format("memory").queryName("limited").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("limited").first().refused == 1
    assert incremental.first_per_key(incremental.stream_files(spark, schema, str(source)), "case_id", "ts").isStreaming


def test_objects_are_replaced(spark, tmp_path):
    path = str(tmp_path / "objects")
    schema = "bucket string, key string, payload binary, content_type string, metadata map<string,string>"
    sinks.put_objects(spark.createDataFrame([("b", "k", bytearray(b"1"), None, None), ("b", "l", bytearray(b"x"), "text/plain", {"a": "1"})], schema), path)
    sinks.put_objects(spark.createDataFrame([("b", "k", bytearray(b"0"), "text/plain", {"v": "2"})], schema), path)
    got = {r.key: r for r in sinks.stored_objects(spark, path).collect()}
    assert (bytes(got["k"].payload), got["k"].metadata, got["l"].content_type) == (b"0", {"v": "2"}, "text/plain") and len(got) == 2
