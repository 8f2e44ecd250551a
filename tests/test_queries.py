"""Every query against its SQL on DuckDB, and each without SQL for rows and a stable schema."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from weftgraph.plans.catalogue import QUERIES, SQL

EMPTY_HERE = {"comembership", "name_cascade", "stable_versions"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    run = con.execute(SQL[name])
    at = [d[0] for d in run.description]
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in run.fetchall()), key=repr)
    assert got == want
    assert got or name in EMPTY_HERE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and df.schema == QUERIES[name](spark, sf_dir).schema


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
