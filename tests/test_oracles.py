"""Every registered core query runs, and equals its SQL twin where it has one."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from sievemill import catalog


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.SQL:  # compared in test_models and test_units
        assert got
        return
    cursor = duck.execute(catalog.SQL[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    assert got == sorted((tuple(norm(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
