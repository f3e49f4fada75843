"""Queries with SQL against DuckDB, on real and on odd tables."""

import os

import duckdb
import pytest
from gleaner.llm.oracles import ORACLE_SQL
from gleaner.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
