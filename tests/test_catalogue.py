"""Every query of the catalogue against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from plumbline.plans import catalogue

DATA = os.environ.get("PLUMBLINE_TEST_DATA", "/root/testdata/sf0.01")
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, DATA)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert rows
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == sorted(df.columns)
        at = [found.columns.index(c) for c in sorted(found.columns)]
        assert sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr) == rows
