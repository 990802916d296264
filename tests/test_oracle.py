"""Every registered query against its SQL on the same files."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.01"
SOURCES = "region nation customer supplier part orders lineitem events".split()
QUERIES = [*entry_module.ON_TABLES, *entry_module.ON_FILES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = [dict(zip(columns, row)) for row in cursor.fetchall()]
    order = sorted(df.columns)
    assert order == sorted(columns)
    got = sorted(repr([row[c] for c in order]) for row in df.collect())
    assert got == sorted(repr([row[c] for c in order]) for row in expected)
    assert got, "an empty result proves nothing"


def test_entry(spark):
    assert entry_module.entry(spark).columns[:3] == ["month", "orders", "revenue"]
