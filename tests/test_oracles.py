"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from affinity import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def plain(row):
    return tuple(None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v for v in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (plain(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(repr, (plain(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())))


def test_entry(spark):
    assert set(queries.ORACLES) <= set(entry.queries())
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
