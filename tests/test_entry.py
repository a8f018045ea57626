"""Queries and their SQL line up by name, and agree where both exist (engine queries, smallest scale)."""

import duckdb
import pytest

import __spark_entry__
from blockwise.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "orders", "benchmark")


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str([r[c] for c in columns]) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted(str([r[i] for i in place]) for r in want.fetchall())
