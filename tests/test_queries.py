"""Registered queries against their SQL in DuckDB, on a small folder."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    rows = lambda found: sorted((tuple(plain(v) for v in r) for r in found), key=str)
    assert rows([[r[c] for c in columns] for r in df.collect()]) == rows([[r[i] for i in order] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() == 3
