"""Faults that once were: repeated ids, long lists of fields, empty contexts, missing scans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evalloom.functions import text
from evalloom.operators import logs, models, retrieval
from evalloom.plans import tracks
from evalloom.sources import documents, readers


def test_rows_that_share_an_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "Red apples grow. Blue pears fall. Green figs rot.", "pears?"), (1, "One two three. Four five six. Seven eight.", "four?"), (2, None, "x"), (3, "", "x"), (4, "Only one here", None)], "id long, t string, q string").repartition(2)
    got = sorted((r.id, r.text, r.origin_tokens) for r in models.compress_offline(docs, "id", "t", 0.99).collect())
    assert got == [(1, "One two three. Four five six. Seven eight.", 8), (1, "Red apples grow. Blue pears fall. Green figs rot.", 9), (4, "Only one here", 3)]
    half = models.compress_offline(docs, "id", "t", 0.3).collect()
    assert sorted((r.id, r.compressed_tokens) for r in half) == [(1, 3), (1, 3), (4, 3)]
    assert sorted((r.id, r.sentence) for r in retrieval.bm25_sentences(docs.filter("id = 1"), "id", "q", "t", 1).collect()) == [(1, "Blue pears fall."), (1, "Four five six.")]
    assert retrieval.vector_sentences(docs, "id", "q", "t", 1).count() == 3


def test_many_fields_take_no_quadratic_time(spark):
    lines = "\n".join(f"k_{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}: {k}" for k in range(8000)) + "\nk_aaa: last"
    begun = time.perf_counter()
    got = spark.createDataFrame([(lines,)], "t string").select(text.key_values("t").alias("m")).first()["m"]
    assert len(got) == 8000 and got["k_aaa"] == "last" and time.perf_counter() - begun < 20


def test_cases_without_a_context_are_left_out(spark):
    rows = spark.createDataFrame([("q", "c"), ("q", ""), ("q", None), (" ", "c"), (None, "c")], "question string, context string")
    assert logs.with_question(rows).count() == 1 and logs.with_question(rows, context=None).count() == 3
    assert logs.with_question(rows.drop("context")).count() == 3


def test_contracts_of_given_rows(spark):
    rows = spark.createDataFrame([(7, "Seller A"), (8, None)], "k long, name string")
    c = documents.contracts_of(rows, "k", {"seller_name": F.col("name")})
    assert {(r.case_id, r.ground_truth_fields.seller_name) for r in c.collect()} == {("synth-ctr-008", "Seller A"), ("synth-ctr-009", None)}
    first = tracks.case_texts(c).first()["text"].split("\n")
    assert first[0].startswith("contract_no: SYNTH-CTR-") and first[-1].startswith("special_offer_d: ")
    with pytest.raises(ValueError, match="no such fields"):
        documents.contracts_of(rows, "k", {"nonsense": F.col("name")})


def test_contract_checks(spark):
    c = documents.synthetic_contracts(spark, 4)
    number = F.col("ground_truth_fields")["contract_no"]
    pages = c.select("case_id", F.lit(3).alias("page_count"), F.concat(F.lit("MARK  one\n"), number).alias("text"))
    good = documents.contract_checks(c, pages, 4, ("MARK one",))
    assert all(r.passed for r in good.collect()) and good.count() == 7
    odd = pages.filter("case_id <> 'synth-ctr-001'").withColumn("page_count", F.when(F.col("case_id") == "synth-ctr-002", 2).otherwise(3)).withColumn("text", F.when(F.col("case_id") == "synth-ctr-003", F.lit("MARK one")).otherwise(F.col("text")))
    got = {r.check: (r.passed, r.detail) for r in documents.contract_checks(c, odd, 4, ("MARK one",)).collect()}
    assert got["scans"] == (False, "3 of 4") and got["records"] == (True, "4 of 4") and got["scan missing"] == (False, "synth-ctr-001")
    assert got["not 3 pages"] == (False, "synth-ctr-002") and got["contract number not in the scan"] == (False, "synth-ctr-003") and got["record missing"][0]


def test_missing_scans_are_read_again(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.pdf").write_text(f"text of {name}")
    files = readers.objects(spark, str(tmp_path))
    make = lambda: documents.text_engine
    stored = documents.ocr(files.filter(F.col("path").endswith("a.pdf")), "tesseract", make, "old").unionByName(documents.ocr(files, "easyocr", make))
    got = documents.with_reruns(stored, files, "tesseract", make, "new").collect()
    assert {(r.case_id, r.ocr_version, r.text_blocks[0].text) for r in got} == {("a", "old", "text of a"), ("b", "new", "text of b")}


def test_profiles_are_found_in_order(tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.yaml").write_text("name: one\nkey: ${K}\n")
    (tmp_path / "p" / "two").write_text("name: two\n")
    (tmp_path / "p" / "config.yaml").write_text("- one\n- two\n")
    monkeypatch.chdir(tmp_path)
    folder = str(tmp_path / "p")
    assert [x["name"] for x in readers.profile_chain(folder, env={"K": "v"})] == ["one", "two"] and readers.profile("one", folder, {"K": "v"})["key"] == "v"
    (tmp_path / "one").write_text("name: nearer\n")
    assert readers.profile("one", folder)["name"] == "nearer" and readers.profile(str(tmp_path / "p" / "two"), folder)["name"] == "two"
    with pytest.raises(FileNotFoundError):
        readers.profile("absent", folder)


def test_question_answering_broadcasts_no_table_that_grows_with_the_contracts(spark):
    contracts = documents.synthetic_contracts(spark, 1000)
    # what small files hold may be many words: no size of a file may lead Spark to send them to the driver
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        rows = tracks.track2(contracts).groupBy("config").count().collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(rows) == 7 and all(r["count"] == 2000 for r in rows)


def test_bm25_in_rows_ranks_as_over_joins(spark):
    draw = random.Random(4)
    said = lambda n: " ".join(draw.choice("abcdefghij") for _ in range(n))
    rows = [(q, said(draw.randrange(6)), [said(draw.randrange(12)) for _ in range(draw.randrange(9))]) for q in range(300)]
    rows += [(300, None, ["a", "b"]), (301, "a b", None), (302, "b a b", ["a", None, "b", "a", "b b"]), (303, "a", ["", ""])]
    df = spark.createDataFrame(rows, "q int, question string, texts array<string>")
    got = {r.q: r.order for r in retrieval.bm25_in_rows(df, "question", F.col("texts"), "order").collect()}
    pairs = df.select("q", "question", F.posexplode("texts").alias("i", "text")).withColumn("prior", F.col("i"))
    ranked = {q: [] for q, *_ in rows}
    for r in retrieval.bm25(pairs, "q", "question", "i", "text", "prior").orderBy("q", F.desc(F.round("score", 9)), "i").collect():
        ranked[r.q].append(r.i)
    assert got == ranked and any(k != sorted(k) for k in got.values())
