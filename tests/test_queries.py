"""Every registered core query against DuckDB on the same tables."""

import os

import duckdb
import pytest

from nestlake.plans import container_queries  # noqa: F401 - registers its queries with core
from nestlake.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    df = core.queries()[name](spark, SF)
    rows = df.collect()
    assert name in core.SQL
    found = con.sql(core.SQL[name])
    names = list(found.columns)
    assert set(names) == set(df.columns)
    assert sorted((plain([r[c] for c in names]) for r in rows), key=str) == sorted((plain(r) for r in found.fetchall()), key=str)
