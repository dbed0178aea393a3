"""Every query with SQL against an independent engine."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomstead.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def same(spark, duck, data, name, query, sql):
    df = query(spark, data)
    other = duck.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    columns = sorted(df.columns)
    at = [other.columns.index(c) for c in columns]
    got = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(canon(r[i]) for i in at) for r in other.fetchall()), key=repr)


@pytest.mark.parametrize("name", list(plans.ORACLE_SQL))
def test_against_sql(spark, duck, data, name):
    same(spark, duck, data, name, plans.QUERIES[name], plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_without_sql(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 2
