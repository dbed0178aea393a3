"""The corpus queries that SQL can express, against an independent engine."""

import math

import duckdb
import pytest

from loomstead.llm import queries


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df, other = queries.QUERIES[name](spark, data), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    columns = sorted(df.columns)
    at = [other.columns.index(c) for c in columns]
    got = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(canon(r[i]) for i in at) for r in other.fetchall()), key=repr)
