"""Every query of the registry against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = [tuple(r) for r in frame.select(*columns).collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    want = con.sql(registry.ORACLES[name])
    assert columns == sorted(want.columns)
    got = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(tuple(map(norm, r)) for r in rows) == sorted(tuple(map(norm, r)) for r in got)
