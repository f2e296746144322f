"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from palisand.plans import analytics, catalog, models, paths  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.4g}" if abs(v) > 1e-6 else "0"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat()[:19].removesuffix("T00:00:00") if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = df.collect()
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda xs: sorted((tuple(map(plain, x)) for x in xs), key=str)
    assert rows([[r[c] for c in columns] for r in got]) == rows(found.fetchall())
