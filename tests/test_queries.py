"""Registered queries against their SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__

NAMES = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op")]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.4f}".replace("-0.0000", "0.0000")
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return str(v)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in cur.fetchall())
    df = __spark_entry__.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got == want
