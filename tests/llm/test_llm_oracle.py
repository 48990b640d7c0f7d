"""The queries with SQL against DuckDB on the driver's tables."""

import os

import duckdb
import pytest

from lithograph.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = registry.QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=key) == sorted(want.fetchall(), key=key)
