"""Every registered query against its DuckDB SQL on the smallest driver tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from broadsheet.registry.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are not there")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    df = entry_module.queries()[name](spark, str(SF_DIR))
    want = oracle.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = df.collect()
    assert rows
    assert by_name(df.columns, rows) == by_name(want.columns, want.fetchall())
