"""User functions by phase and over two tables with missing groups; join steps' rules."""

import datetime

import pandas as pd
import pytest

from quantloom.operators import groups as G
from quantloom.operators import links as L
from quantloom.operators.panel import Panel

D = datetime.date


def test_ids_by_phase(spark):
    df = spark.createDataFrame([(1, D(2000, m, 28), float(m)) for m in range(1, 7)], "id long, date date, v double")
    p = Panel(df, freq=12, base_freq=4)
    got = G.apply_to_ids(p, lambda x: x[["date"]].assign(d=x["v"].diff()), "date date, d double").collect()
    assert {r.date.month: r.d for r in got if r.d is not None} == {4: 3.0, 5: 3.0, 6: 3.0}


def test_groups_of_one_table_only_and_null_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (None, 2.0), (None, 3.0)], "k long, v double")
    b = spark.createDataFrame([(2, 5.0), (1, 7.0)], "k long, v double")
    both = lambda x, y: pd.DataFrame({"n": [len(x)], "m": [len(y)]})
    got = sorted((r.n, r.m) for r in G.apply_to_groups(a, ["k"], both, "n long, m long", ["v"], b).collect())
    assert got == [(0, 1), (1, 1), (2, 0)]
    assert G.apply_to_groups(a.where("v > 9"), ["k"], lambda x: x, "k long, v double", ["v"]).count() == 0


def test_market_equity(spark):
    a = spark.createDataFrame([("x", D(2001, 6, 30), D(2000, 12, 31), 9.0), ("x", D(2000, 12, 31), D(1999, 12, 31), 9.0)], "gvkey string, date date, datadate date, me double")
    s = spark.createDataFrame([("x", D(2000, 12, 31), 5.0, True), ("x", D(2000, 12, 31), 8.0, False), ("x", D(2001, 6, 30), 6.0, True), ("x", D(1999, 12, 31), -1.0, True), (None, D(2000, 12, 31), 3.0, True)], "gvkey string, date date, me_company double, primary boolean")
    got = {r.date.year: (r.me, r.me_fiscal) for r in L.add_market_equity(a, s).collect()}
    assert got == {2001: (6.0, 5.0), 2000: (5.0, None)}
    got = {r.date.year: (r.me, r.me_fiscal) for r in L.add_market_equity(a, s, "year_end").collect()}
    assert got == {2001: (5.0, 5.0), 2000: (None, None)}
    with pytest.raises(ValueError):
        L.add_market_equity(a, s, "first")


def test_factors_and_names(spark):
    df = spark.createDataFrame([(1, D(2000, 1, 31), 0.5, 7.0), (1, D(2000, 2, 29), 0.5, 7.0)], "id long, date date, rf double, mktrf double")
    f = spark.createDataFrame([(D(2000, 1, 3), 0.1, 0.2, 0.3)], "date date, rf double, mkt double, other double")
    rows = L.merge_with_factors(df, f, {"mktrf": "mkt"}, only=["mktrf"]).orderBy("date").collect()
    assert [(r.rf, r.mktrf) for r in rows] == [(0.5, 0.2), (0.5, None)] and "other" not in rows[0]
    assert L.year_to_date_columns(spark.createDataFrame([("1", 1.0, 2.0)], "gvkey string, saley double, saleq double")) == ["saley"]
