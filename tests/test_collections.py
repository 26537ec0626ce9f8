"""Exact search in a stored collection against comparing everything."""

import numpy as np
import pytest

from evalloom.sources.collections import Collection


def table(spark, x, labels=None):
    return spark.createDataFrame([(i, [float(c) for c in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)], "item_id long, vec array<float>, label int")


def asked(spark, x, ids, labels=None):
    return spark.createDataFrame([(int(i), [float(c) for c in x[i]], int(labels[i]) if labels is not None else 0) for i in ids], "query_id long, query_vec array<float>, label int")


def plain(x, ids, k, labels=None):
    x, out = np.asarray(x, np.float32).astype(float), {}
    for i in ids:
        d = ((x - x[i]) ** 2).sum(1)
        items = [j for j in range(len(x)) if labels is None or labels[j] == labels[i]]
        out[int(i)] = [(j, round(d[j], 5)) for j in sorted(items, key=lambda j: (d[j], j))[:k]]
    return out


def result(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["item_id"], round(r["distance"], 5)))
    return out


@pytest.mark.parametrize("kind", ["clustered", "spread", "copies"])
def test_the_nearest_are_those_of_all_pairs(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 10
    x = {"clustered": centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.3, "spread": rng.normal(size=(800, 16)), "copies": np.repeat(rng.normal(size=(50, 16)), 20, axis=0)}[kind]
    x = np.asarray(x, np.float32)
    labels, ids = rng.integers(0, 3, len(x)), np.arange(0, len(x), 20)
    c = Collection.write(table(spark, x, labels), str(tmp_path / "c"), per_cell=60)
    found, report = c.nearest(asked(spark, x, ids), 5)
    assert result(found) == plain(x, ids, 5)
    if kind == "clustered":
        assert report["pairs_compared"] < 0.2
    found, _ = Collection.open(spark, str(tmp_path / "c")).nearest(asked(spark, x, ids[:20], labels), 4, same="label")
    assert result(found) == plain(x, ids[:20], 4, labels)


def test_few_clusters_asked_read_few_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.asarray((rng.normal(size=(30, 8)) * 20)[np.arange(3000) % 30] + rng.normal(size=(3000, 8)) * 0.1, np.float32)
    c = Collection.write(table(spark, x), str(tmp_path / "c"), per_cell=50)
    found, report = c.nearest(asked(spark, x, range(0, 300, 30)), 3)
    assert result(found) == plain(x, range(0, 300, 30), 3) and report["cells_read"] < 0.5 and report["pairs_compared"] < 0.1


def test_odd_vectors_blocks_and_empty_collections(spark, tmp_path, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (None, [1.0, 0.0]), (5, []), (6, [1.0, None]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>")
    c = Collection.write(df, str(tmp_path / "a"))
    q = spark.createDataFrame([(0, [0.0, 0.9]), (9, None), (10, [float("nan"), 1.0]), (11, [1.0] * 3), (12, [0.9, 0.0])], "query_id long, query_vec array<double>")
    kept = {2: {1, 7}, 3: {8}}[c.pivots.shape[1]]
    assert {r["item_id"] for r in c.rows().collect()} == kept
    whole = result(c.nearest(q, 2)[0])
    monkeypatch.setattr("evalloom.sources.collections.MOST_BYTES", 16)
    assert result(c.nearest(q, 2)[0]) == whole and len(whole) in (1, 2)
    empty = Collection.write(df.filter("false"), str(tmp_path / "b"))
    assert empty.nearest(q, 2)[0].count() == 0
    assert c.nearest(q.filter("false"), 2)[0].count() == 0
