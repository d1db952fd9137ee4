"""Every registered query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from brickyard import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(columns: list[str], rows: list) -> list[tuple]:
    def one(x):
        if x is None:
            return ""
        return repr(round(float(x), 6)) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    got = plans.QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    if name in plans.ORACLES:
        want = oracle.sql(plans.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert _plain(got.columns, got.collect()) == _plain(want.columns, want.fetchall())
    else:
        assert got.count() >= 0


def test_entry_works_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["job_id", "rank", "home_id", "location_id", "km"]
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
