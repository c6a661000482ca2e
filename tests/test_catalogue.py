"""Every catalogue query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from vireo.plans.catalogue import QUERIES
from vireo.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool | str):
        return str(value)
    return repr(float(value))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
