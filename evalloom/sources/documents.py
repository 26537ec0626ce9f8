"""Scanned documents as OCR results, and synthetic contracts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions.text import case_key, money_words
from evalloom.session import ship

#: An OCR engine: bytes -> list of (page, box of four numbers, text, confidence).
Engine = Callable[[bytes], list[tuple[int, list[float], str, float]]]


def text_engine(content: bytes) -> list[tuple[int, list[float], str, float]]:
    """The offline engine: UTF-8 text, pages apart by form feeds, a block a line."""
    pages = content.decode("utf-8", "replace").split("\f")
    return [(p, [0.0, float(k), 1.0, float(k + 1)], line, 1.0) for p, page in enumerate(pages, 1) for k, line in enumerate(page.splitlines()) if line.strip()]


def ocr(files: DataFrame, provider: str, make: Callable[[], Engine], version: str = "1") -> DataFrame:
    """OCR results of binaryFile rows. The engine is made once a task; what it raises becomes the row's error."""
    ship(files.sparkSession)
    block = pa.list_(pa.struct([("page", pa.int32()), ("bbox", pa.list_(pa.float64())), ("text", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make()
        for batch in batches:
            blocks, pages, ms, errors = [], [], [], []
            for content in batch.column(1):
                begun = time.perf_counter()
                try:
                    found, error = engine(content.as_py()), None
                except Exception as e:  # noqa: BLE001  the contract: errors are rows
                    found, error = [], f"{type(e).__name__}: {e}"
                blocks.append([{"page": p, "bbox": b, "text": t, "confidence": c} for p, b, t, c in found])
                pages.append(max((p for p, *_ in found), default=1))
                ms.append(round((time.perf_counter() - begun) * 1000, 1))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.int32()), pa.array(blocks, block), pa.array(ms), pa.array(errors, pa.string())], names=["case_id", "page_count", "text_blocks", "latency_ms", "error"])

    kinds = "case_id string, page_count int, text_blocks array<struct<page:int,bbox:array<double>,text:string,confidence:double>>, latency_ms double, error string"
    out = files.select(case_key("path").alias("case_id"), "content").mapInArrow(run, kinds)
    return out.withColumns({"ocr_provider": F.lit(provider), "ocr_version": F.lit(version)})


def box_of(polygon: Column) -> Column:
    """[left, top, right, bottom] of an array of points."""
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


# Models with price bands in VND, versions, colours, titles, offers.
MODELS = (("VF 3", 340_000_000, 420_000_000), ("VF 5", 520_000_000, 620_000_000), ("VF 6", 680_000_000, 780_000_000), ("VF 7", 880_000_000, 1_000_000_000), ("VF 8", 1_050_000_000, 1_300_000_000), ("VF 9", 1_500_000_000, 1_900_000_000))
VERSIONS, COLOURS = ("Base", "Plus", "Eco"), ("Đen", "Trắng", "Đỏ", "Xanh", "Bạc")
TITLES = ("Giám đốc", "Phó Giám đốc", "Trưởng phòng Kinh doanh")
SELLER = "Công ty TNHH Kinh doanh Ô tô Điện SYNTH Việt Nam"


def synthetic_contracts(spark: SparkSession, n: int, seed: int = 42, anchor: str = "2026-01-01") -> DataFrame:
    """case_id, source_pdf, schema_version, language, ground_truth_fields of ``n`` contracts."""
    return contracts_of(spark.range(n), "id", {}, seed, anchor)


def contracts_of(parties: DataFrame, key: str, known: dict[str, Column], seed: int = 42, anchor: str = "2026-01-01") -> DataFrame:
    """One contract for each row of a table. ``known`` names the fields that the table has values for.

    Every other field follows from a hash of (key, field, seed) and dates from ``anchor``, so a run can be repeated and split.
    """
    i = F.col(key).cast("long") + 1
    draw = lambda name, m: F.pmod(F.xxhash64(F.lit(name), i, F.lit(seed)), F.lit(m))
    digits = lambda name, k: F.lpad(draw(name, 10**k).cast("string"), k, "0")
    letter = lambda name: F.chr(65 + draw(name, 26))
    pick = lambda name, options: F.element_at(F.array(*map(F.lit, options)), (draw(name, len(options)) + 1).cast("int"))
    model = draw("model", len(MODELS)).cast("int")
    at = lambda k: F.element_at(F.array(*[F.lit(m[k]) for m in MODELS]), model + 1)
    price = (at(1) + F.pmod(draw("price", 1 << 40), F.floor((at(2) - at(1)) / 10_000_000)) * 10_000_000).cast("long")
    number = F.format_string("%03d", i)
    instalments = draw("method", 100) < 45
    own = (F.round(price * (0.2 + draw("own", 1000) / 5000), -6)).cast("long")
    fields = {
        "case_id": F.concat(F.lit("synth-ctr-"), number),
        "source_pdf": F.concat(F.lit("contract_synth-ctr-"), number, F.lit(".pdf")),
        "contract_no": F.concat(F.lit("SYNTH-CTR-"), number, F.lit("/"), F.format_string("%04d", (F.lit(seed) + i) % 9999)),
        "sign_date": F.date_sub(F.lit(anchor).cast("date"), draw("sign", 91).cast("int")).cast("string"),
        "seller_name": F.lit(SELLER),
        "seller_address": F.concat(F.lit("SYNTH street "), draw("sa", 500).cast("string")),
        "seller_tax_id": F.concat(F.lit("SYNTH"), digits("tax", 10)),
        "seller_rep": F.concat(F.lit("SYNTH rep "), draw("rep", 900).cast("string")),
        "seller_rep_title": pick("title", TITLES),
        "seller_bank": F.concat(F.lit("SYNTH bank "), draw("bank", 5).cast("string")),
        "seller_account": digits("account", 12),
        "seller_account_holder": F.lit(SELLER),
        "buyer_name": F.concat(F.lit("SYNTH-buyer "), draw("buyer", 9000).cast("string")),
        "buyer_address": F.concat(F.lit("SYNTH street "), draw("ba", 500).cast("string")),
        "buyer_phone": F.concat(F.lit("+84-SYNTH-"), digits("phone", 9)),
        "buyer_email": F.concat(F.lit("buyer."), number, F.lit("@example.test")),
        "buyer_id": F.concat(F.lit("SYNTH"), digits("bid", 9)),
        "model": at(0),
        "version": pick("version", VERSIONS),
        "color": pick("colour", COLOURS),
        "vin": F.concat(F.lit("SYNTH"), letter("v1"), letter("v2"), digits("vin", 10)),
        "includes_battery": draw("battery", 100) < 55,
        "unit_price_vnd": price,
        "total_price_words_vi": money_words(price),
        "payment_stage_1_vnd": F.greatest(F.round(price * (0.1 + draw("stage", 1000) / 5000), -6), F.lit(50_000_000)).cast("long"),
        "payment_method": F.when(instalments, "trả góp").otherwise("trả thẳng"),
        "own_capital_vnd": F.when(instalments, own),
        "credit_notice_vnd": F.when(instalments, price - own),
        "delivery_date": F.date_add(F.lit(anchor).cast("date"), draw("delivery", 61).cast("int")).cast("string"),
        "delivery_place": F.concat(F.lit("SYNTH city "), draw("place", 60).cast("string")),
        "special_offer_a": F.lit("Ưu đãi giảm 2% theo CTKM SYNTH-AUTUMN-2026"),
        "special_offer_b": F.lit("Tặng 5.000.000 VNĐ phụ kiện chính hãng"),
        "special_offer_c": F.lit("CBNV cấp bậc Senior — giảm thêm 1,5%"),
        "special_offer_d": F.lit("Vinclub hạng Gold — tích điểm 1,2x"),
        "page2_notes": F.array(F.lit("Khách Hàng cần duy trì eSIM để sử dụng các tính năng thông minh."), F.lit("Bên Bán sẽ xử lý dữ liệu cá nhân theo Chính sách Bảo vệ Dữ liệu Cá nhân SYNTH.")),
    }
    unknown = sorted(set(known) - set(fields))
    if unknown:
        raise ValueError(f"no such fields: {unknown}")
    rows = parties.select(*[c.alias(k) for k, c in (fields | known).items()])
    return rows.select("case_id", "source_pdf", F.lit("phase03.v1").alias("schema_version"), F.lit("vi").alias("language"), F.concat(F.lit("scans/"), "source_pdf").alias("source_scan_pdf"), F.struct(*fields).alias("ground_truth_fields"))


def contract_problems(contracts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(case_id, problem) rows: marks that are missing, and documents that do not have three pages."""
    f = F.col("ground_truth_fields")
    checks = (("vin without mark", ~F.startswith(f["vin"], F.lit("SYNTH"))), ("tax id without mark", ~F.startswith(f["seller_tax_id"], F.lit("SYNTH"))), ("e-mail outside the test domain", ~F.endswith(f["buyer_email"], F.lit("@example.test"))), ("no price", ~(f["unit_price_vnd"] > 0)))
    found = contracts.select("case_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(what)) for what, bad in checks]))).alias("problem"))
    return found if pages is None else found.unionByName(pages.filter("page_count <> 3").select("case_id", F.lit("not three pages").alias("problem")))


def contract_checks(contracts: DataFrame, pages: DataFrame, expected: int, marks: tuple[str, ...] = (), n_pages: int = 3) -> DataFrame:
    """(check, passed, detail) of a set of contracts against its scans: pages (case_id, page_count, text).

    Counts of records and scans, pages and marks of every scan, and the contract number of every record in its scan's text.
    ``detail`` names up to ten cases that fail.
    """
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    said = plain(F.col("text"))
    both = contracts.select("case_id", F.col("ground_truth_fields")["contract_no"].alias("number")).join(pages.select("case_id", "page_count", "text", F.lit(True).alias("scanned")), "case_id", "full")
    each = {
        "scan missing": F.col("scanned").isNull(),
        "record missing": F.col("number").isNull(),
        f"not {n_pages} pages": F.col("scanned") & (F.coalesce("page_count", F.lit(0)) != n_pages),
        "contract number not in the scan": F.col("scanned") & F.col("number").isNotNull() & ~F.contains(said, plain(F.col("number"))),
    } | {f"mark {m!r} not in the scan": F.col("scanned") & ~F.contains(said, F.lit(m)) for m in marks}
    failed = both.select("case_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in each.items()]))).alias("check"))
    few = failed.withColumn("k", F.row_number().over(Window.partitionBy("check").orderBy("case_id"))).filter("k <= 10").groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("case_id")), ", ").alias("cases"))
    names = contracts.sparkSession.createDataFrame([(n,) for n in each], "check string").join(few, "check", "left")
    counts = contracts.agg(F.count("*").alias("n")).select(F.lit("records").alias("check"), "n").unionByName(pages.agg(F.count("*").alias("n")).select(F.lit("scans").alias("check"), "n"))
    counted = counts.select("check", (F.col("n") == expected).alias("passed"), F.format_string("%d of %d", "n", F.lit(expected)).alias("detail"))
    return counted.unionByName(names.select("check", F.col("cases").isNull().alias("passed"), F.coalesce("cases", F.lit("")).alias("detail")))


def with_reruns(stored: DataFrame, files: DataFrame, provider: str, make: Callable[[], Engine], version: str = "1") -> DataFrame:
    """The stored OCR results of a provider, and where a file has none, those of running the engine on it."""
    own = stored.filter(F.col("ocr_provider") == provider)
    missing = files.withColumn("case_", case_key("path")).join(own.select(F.col("case_id").alias("case_")).distinct(), "case_", "left_anti").drop("case_")
    again = ocr(missing, provider, make, version)
    return own.select(*again.columns).unionByName(again)
