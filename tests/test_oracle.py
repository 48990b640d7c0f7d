"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from lithograph.plans import queries, registry  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if not isinstance(v, (int, bool, str, type(None))) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(map(repr, r))
    mine = sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=key)
    theirs = sorted((tuple(map(_plain, r)) for r in want.fetchall()), key=key)
    assert mine == theirs and mine
