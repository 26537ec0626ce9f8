"""Registered queries run on the smallest tables; those with a SQL twin agree with DuckDB."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from evalloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(str([plain(r[k]) for k in at]) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_track1_invariants(spark, small):
    rows = {r.config: r for r in QUERIES["track1_summary"](spark, small).collect()}
    assert set(rows) == {"A", "B", "D", "B+D", "D-strong"}
    assert rows["A"].avg_pii_recall == 0 and rows["D"].avg_pii_recall > 0
    assert rows["A"].avg_field_f1 >= rows["D"].avg_field_f1 and rows["D"].avg_field_f1 == rows["D-strong"].avg_field_f1


def test_track2_invariants(spark, small):
    rows = {r.config: r for r in QUERIES["track2_summary"](spark, small).collect()}
    assert len(rows) == 7 and all(r.refusal_accuracy == 1.0 and r.n_refusal * 2 == r.n_cases for r in rows.values())
