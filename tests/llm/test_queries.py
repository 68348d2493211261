"""The registered queries of this subpackage against their SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from modlark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    found = queries.queries()[name](spark, sf_dir)
    told = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=key) == sorted(told.fetchall(), key=key)
