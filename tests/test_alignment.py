"""Edit distance and matching blocks against plain versions, and their time on long inputs."""

import difflib
import random
import time

import pytest

from evalloom.operators import alignment, models
from evalloom.plans import registry


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("band", [1, 2, 5, 64])
def test_edit_distance(band, monkeypatch):
    monkeypatch.setattr(alignment, "BAND", band)
    rng = random.Random(band)
    for _ in range(2500):
        letters = rng.choice(["ab", "abcde", "aé日𝒳 "])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.9) + rng.choice(["", "ab"])
        assert alignment.edit_distance(a, b) == plain_distance(a, b), (a, b)


def test_a_page_of_100_000_characters():
    rng = random.Random(1)
    page = "".join(rng.choice("abcdefghij klmnop") for _ in range(100_000))
    read = "".join(c if rng.random() > 0.02 else rng.choice(["", "x", c + "y"]) for c in page)
    begun = time.perf_counter()
    d = alignment.edit_distance(page, read)
    assert 1000 < d < 2500 and time.perf_counter() - begun < 5
    assert alignment.edit_distance(page, "") == 100_000 and alignment.edit_distance(page, page[:500] + page[501:]) == 1


def test_error_rates(spark):
    rows = spark.createDataFrame([(None, ""), ("", "a"), ("a", None), ("abc", "abd"), ("x" * 5000, "x" * 5000 + "y")], "h string, r string")
    assert [r.cer for r in alignment.with_error_rates(rows, "h", "r").collect()] == [0.0, 1.0, 1.0, 1 / 3, 1 / 5001]


def cells(rng, n, kinds):
    return [f"c{min(rng.randrange(kinds), rng.randrange(kinds))}" for _ in range(n)]


def test_matching_blocks_are_the_published_ones():
    rng = random.Random(2)
    for k in range(1500):
        kinds = rng.choice([1, 2, 5, 40, 400])
        a = cells(rng, rng.randint(0, 40), kinds)
        b = cells(rng, rng.randint(0, 40), kinds) if k % 2 else [x for x in a if rng.random() < 0.8]
        if k % 15 == 0:  # popular items
            a, b = cells(rng, 260, 60), cells(rng, rng.randint(195, 320), 60)
            a[20:120] = b[40:140]
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert alignment.matching_size(a, b) == want, (a, b)


def test_long_lists_of_few_kinds_take_linear_time_a_block():
    rng = random.Random(3)
    a = [rng.choice("abc") + rng.choice("xyz") + rng.choice("01234567890123456789") for _ in range(15_000)]
    b = a[:7000] + ["new"] + a[7000:]
    begun = time.perf_counter()
    assert alignment.matching_size(a, b) == 15_000 and alignment.matching_size(["a"] * 150, ["a"] * 199) == 150
    assert time.perf_counter() - begun < 10


def test_the_query_on_turns(spark, small):
    rows = registry.turn_pairs(spark, small).collect()
    got = {(r.conv_id, r.turn): (r.teds, r.n_pred, r.n_ref) for r in registry.table_teds(spark, small).collect()}
    clean = lambda t: [c for c in (x.strip().lower() for x in (t or "").split(" ")) if c]
    assert len(got) == len(rows) > 50
    for r in rows:
        a, b = clean(r["text"]), clean(r["next"])
        want = 1.0 if not a and not b else 0.0 if not a or not b else round(difflib.SequenceMatcher(None, a, b).ratio(), 4)
        assert got[r["conv_id"], r["turn"]] == (want, len(a), len(b))


def test_similarity_of_empty_tables():
    assert models.table_similarity([], []) == 1.0 and models.table_similarity(["a"], []) == 0.0 == models.table_similarity([], ["a"])
