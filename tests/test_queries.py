"""Every query of the library against the same in DuckDB SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from syncwright import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(columns), sorted((repr([plain(r[k]) for k in order]) for r in values))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())
