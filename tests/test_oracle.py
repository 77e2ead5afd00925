"""Every query with an oracle gives its rows; the others run and keep their schema."""

import datetime
import math
import os

import duckdb
import pytest

from ringside import all_queries as queries

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value + 0.0:.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
