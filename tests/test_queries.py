"""Registered queries against DuckDB on the small tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from quantloom.plans.charqueries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v.isoformat()[:10] if isinstance(v, (datetime.date, datetime.datetime)) else v


def _close(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5))


def _order(r):
    return [str(x) for x in r if not isinstance(x, float)], [round(x, 3) for x in r if isinstance(x, float)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(([_value(r[c]) for c in cols] for r in df.collect()), key=_order)
    at = [rel.columns.index(c) for c in cols]
    want = sorted(([_value(r[i]) for i in at] for r in rel.fetchall()), key=_order)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not all(map(_close, a, b))]
    assert not bad, (len(bad), len(got), bad[:2])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and any(v is not None for r in rows for v in r)
