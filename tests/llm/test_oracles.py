"""The SQL of the operators that have some gives the rows of their queries."""

import duckdb
import pytest

from plumbline.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(name, spark):
    duck = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{DATA}/{name_}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    mine = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect())
    theirs = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in at)) for r in found.fetchall())
    assert len(mine) == len(theirs) and sum(a != b for a, b in zip(mine, theirs)) == 0
