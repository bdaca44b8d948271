"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from pointfold.jobs import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())
