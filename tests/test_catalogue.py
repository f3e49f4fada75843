"""Every catalogue query against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest
from gleaner.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(rows):
    cell = lambda v: (1, round(v, 6) if math.isfinite(v) else str(v)) if isinstance(v, float) else (0, v) if not isinstance(v, (int, bool)) else (1, float(v))
    return sorted(([cell(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [got.columns.index(c) for c in want.columns]
    mine = normal(tuple(r[i] for i in order) for r in got.collect())
    theirs = normal(want.fetchall())
    assert mine == theirs
    assert mine or name == "global_agg_empty"


def test_flattened_values_are_there(spark):
    rows = catalogue.QUERIES["json_flatten_props"](spark, SF)
    assert rows.columns == ["event_id", "props.k"] and rows.where("`props.k` is null").count() == 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
