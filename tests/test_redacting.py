"""The scanner against plain runs of all patterns, long texts in linear time, and the same results as the columns."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from evalloom.functions import redaction
from evalloom.operators import redacting

PARTS = [
    "012345678", "123456789", "123456789012", "0123456789", "1234567890", "12", "29A", "30F-12345", "51G 1234", "99B12345", "+84 912 345 678", "+84912345678", "0912 345 678", "84",
    "a@b.vn", "x.y+z@mail.example.com", "@", "..@a.b", "a@b@c.de", "@b.com", "é@b.com", "-_-@d.io", "MST: 0123456789", "mã số thuế - 0123456789-001", "Tax  ID:1234567890 12", "ma so thue", "STK: 0123 4567 8901", "số tk 12345678-9",
    "tài khoản: 1", "1HGCM82633A004352", "WAUZZZ8K9AA000000X", "ông Nguyễn Văn An", "bà: Trần", "khách  hàng - Lê Thị Hoa Mai Lan", "người mua Phạm Đức", "anh", "buyer John Smith", "them", "représentative", "em Ơn",
    " ", " ", "\n", ", ", ".", "-", "x", "é", "日本", "٣٤٥٦٧٨٩٠١", "_", "0",
]


def plain_spans(text, policy, patterns):
    names = list(patterns)
    raw = [(m.start() - m.end(), m.start(), names.index(n), m.end(), n) for n, p in patterns.items() if n in policy.categories for m in re.finditer(p, text)]
    kept = []
    for _, a, _, b, n in sorted(raw):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, n))
    return sorted(kept)


@pytest.mark.parametrize("patterns", [redaction.PATTERNS, redaction.STRICT_PATTERNS])
@pytest.mark.parametrize("short", [0, 400])
def test_scanner_finds_what_all_patterns_find(patterns, short, monkeypatch):
    monkeypatch.setattr(redacting, "SHORT", short)
    rng, scanner = random.Random(4), redacting.Scanner(redaction.DEFAULT, patterns)
    found = 0
    for _ in range(4000):
        t = "".join(rng.choice(PARTS) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 9)))
        want = plain_spans(t, redaction.DEFAULT, patterns)
        assert scanner.spans(t) == want, t
        found += len(want)
    assert found > 2000


def test_each_category_is_found_alone():
    for name, example in {"cccd": "123456789", "phone_vn": "0912345678", "email": "a@b.vn", "tax_id": "MST: 0123456789", "bank_account": "STK: 12345678901", "vin": "1HGCM82633A004352", "license_plate": "30F-12345", "person_name": "ông An"}.items():
        policy = redaction.Policy(categories={name: redaction.DEFAULT.categories[name]})
        assert redacting.Scanner(policy).spans(f"x, {example};") == [(3, 3 + len(example), name)]


def test_long_texts_take_linear_time():
    scanner, begun = redacting.Scanner(), time.perf_counter()
    assert len(scanner.spans("a@b.vn 0912345678, " * 50_000)) == 100_000
    assert scanner.spans("a." * 300_000) == [] and scanner.spans("@" * 300_000) == [] and scanner.spans("a@" + "b." * 300_000) == []
    assert scanner.spans("9" * 500_000) == [] and len(scanner.redact("ông An " * 50_000)["spans"]) > 10_000
    assert time.perf_counter() - begun < 20


def test_tables_and_columns_agree(spark):
    rng = random.Random(7)
    texts = [None, "", "a@b.vn", "ông Nguyễn Văn An: a@b.vn a@b.vn", *[" ".join(rng.choice(PARTS[:41]) for _ in range(rng.randint(1, 6))) for _ in range(150)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("REDACTED", F.lit("clash"))
    mixed = redaction.Policy(categories=redaction.DEFAULT.categories | {"email": redaction.Category("hash"), "vin": redaction.Category("keep_token")})
    both = redacting.redact_texts(df, "text", mixed).withColumn("other", redaction.redact(F.col("text"), mixed)).collect()
    assert len(both) == len(texts)
    for r in both:
        a, b = r["redacted"].asDict(recursive=True), r["other"].asDict(recursive=True)
        assert a == b, r["text"]
    row = next(r["redacted"] for r in both if r["id"] == 3)
    assert row["text"] == "ông Nguyễn Văn An: [HASH:{0}] [HASH:{0}]".format(hashlib.sha256(b"a@b.vn").hexdigest()[:8])
    assert redacting.redact_texts(df.filter("false"), "text").count() == 0
