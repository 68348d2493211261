"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from modlark import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    told = duck.execute(ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == cols
    expected = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in told.fetchall()), key=repr)
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
