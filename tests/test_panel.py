"""Small cases with known results for the operators along time and across ids."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.columns import sum_present
from quantloom.operators import analytics as A
from quantloom.operators import cross as X
from quantloom.operators import joins as J
from quantloom.operators.panel import MONTHLY, Panel, add_months


def d(y, m, day=1):
    return dt.date(y, m, day)


def vector(spark):
    return spark.createDataFrame([(i, float(i)) for i in range(1, 12)], "id long, x double")


def test_classes_of_a_vector(spark):
    df = vector(spark)
    five = [r[0] for r in X.classify(df, "x", 5, "c", []).orderBy("id").select("c").collect()]
    assert five == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    two = [r[0] for r in X.classify(df, "x", [0.3, 0.7], "c", []).orderBy("id").select("c").collect()]
    assert two == [0] * 4 + [1] * 4 + [2] * 3
    down = [r[0] for r in X.classify(df, "x", [0.3, 0.7], "c", [], ascending=False).orderBy("id").select("c").collect()]
    assert down == [2 - c for c in two]


def test_trim_and_winsorize_a_vector(spark):
    df = vector(spark)
    keep = [r[0] for r in X.trim(df, "x", (0.1, 0.1), "k", []).orderBy("id").select("k").collect()]
    assert keep == [False] + [True] * 9 + [False]
    w = [r[0] for r in X.winsorize(df, "x", (0.1, 0.1), "w", []).orderBy("id").select("w").collect()]
    assert w == [2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10]


def test_rank_leaves_out_nulls_and_averages_ties(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 4.0), (3, 2.0), (4, None), (5, 5.0), (6, 2.0)], "id long, x double")
    r = {x[0]: x[1] for x in df.select("id", X.rank("x", [F.lit(1)])).collect()}
    assert r == {1: 3, 2: 4, 3: 1.5, 4: None, 5: 5, 6: 1.5}


def test_null_values_give_no_class(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0)], "id long, x double")
    assert {r.id: r.c for r in X.classify(df, "x", 2, "c", []).collect()} == {1: None, 2: 0, 3: 1}
    assert X.classify(df.where("false"), "x", 2, "c", []).count() == 0


def test_populate_fills_at_most_limit_rows(spark):
    df = spark.createDataFrame([(1, d(2000, 12, 31), 1.0), (1, d(2001, 12, 31), 2.0), (2, d(2005, 6, 30), 5.0), (2, d(2006, 6, 30), None)], "id long, date date, x double")
    p = Panel(df)
    assert p.populate(MONTHLY, limit=12).df.count() == 26
    got = {(r.id, r.date): r.x for r in p.populate(MONTHLY, limit=3).df.collect()}
    assert got[1, d(2001, 3, 31)] == 1 and got[1, d(2001, 4, 30)] is None and got[1, d(2001, 12, 31)] == 2
    lagged = {(r.id, r.date): r.x for r in p.populate(MONTHLY, limit=3, lag=4).df.collect()}
    assert lagged[1, d(2001, 4, 30)] == 1 and lagged[1, d(2001, 3, 31)] is None
    none = p.populate(MONTHLY).df.where("x is not null").count()
    assert none == 3


def test_rolling_needs_enough_values(spark):
    df = spark.createDataFrame([(1, d(2000, m, 28), x) for m, x in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0], 1)], "id long, date date, x double")
    p = Panel(df)
    full = [r[0] for r in p.df.select("date", p.rolling("x", 3, "sum").alias("r")).orderBy("date").select("r").collect()]
    assert full == [None, None, None, None, None, 15]
    two = [r[0] for r in p.df.select("date", p.rolling("x", 3, "sum", 2).alias("r")).orderBy("date").select("r").collect()]
    assert two == [None, 3, 3, 6, 9, 15]


def test_sum_present(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(sum_present("a", "b")).collect()] == [None, 1, 3]


def test_add_months(spark):
    df = spark.createDataFrame([(d(2000, 1, 31),), (d(2000, 1, 15),)], "x date")
    assert [r[0] for r in df.select(add_months("x", 1)).collect()] == [d(2000, 2, 29), d(2000, 1, 31)]


def test_keep_row_filters(spark):
    df = spark.createDataFrame([(1, d(2000, 1), 1.0, 7), (1, d(2000, 2), None, 8), (1, d(2000, 3), 3.0, 9)], "id long, date date, x double, y int")
    p = Panel(df).filter([("x", ">", 2.0)], keep_row=True)
    assert [r.y for r in p.df.orderBy("date").collect()] == [None, 8, 9]
    assert Panel(df).filter([("x", "!=", 1.0)]).df.count() == 2


def test_merge_policies(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k long, v int")
    b = spark.createDataFrame([(1, 11), (3, 31)], "k long, v int")
    assert {tuple(r) for r in J.merge(a, b, ["k"], "left", "right").collect()} == {(1, 10), (2, 20)}
    assert {tuple(r) for r in J.merge(a, b, ["k"], "left", "left").collect()} == {(1, 11), (2, None)}
    assert {tuple(r) for r in J.merge(a, b, ["k"], "full").collect()} == {(1, 10, 11), (2, 20, None), (3, None, 31)}


def test_asof_takes_the_latest_start_even_if_ended(spark):
    left = spark.createDataFrame([(1, d(2000, 5)), (1, d(1999, 1)), (2, d(2000, 5))], "k long, t date")
    right = spark.createDataFrame([(1, d(2000, 1), None, "open"), (1, d(2000, 2), d(2000, 3), "ended")], "k long, s date, e date, v string")
    got = {(r.k, r.t): r.v for r in J.asof(left, right, "k", "t", "s", "e", ["v"]).collect()}
    assert got == {(1, d(2000, 5)): None, (1, d(1999, 1)): None, (2, d(2000, 5)): None}


def test_ols_by_group_agrees_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + rng.normal(size=60)
    rows = [(i // 30, float(y[i]), *map(float, x[i])) for i in range(60)]
    got = {r.g: r for r in A.grouped_ols(spark.createDataFrame(rows, "g long, y double, a double, b double, c double"), ["g"], "y", ["a", "b", "c"]).collect()}
    for g in (0, 1):
        s = slice(g * 30, g * 30 + 30)
        b = np.linalg.lstsq(np.column_stack([np.ones(30), x[s]]), y[s], rcond=None)[0]
        assert np.allclose([got[g].b_const, got[g].b_a, got[g].b_b, got[g].b_c], b)


def test_f_distribution():
    # Known upper tails of F: 4.10 at (2, 10) and 2.76 at (4, 30) are 5 %.
    for f, a, b in ((4.1028, 2, 10), (2.6896, 4, 30)):
        assert abs(1 - A._betainc(a / 2, b / 2, a * f / (a * f + b)) - 0.05) < 1e-4


def test_panel_round_trip(spark, tmp_path):
    from quantloom.sources.io import load_panel, save_panel

    df = spark.createDataFrame([(1, d(2000, 1), 1.0)], "id long, date date, x double")
    save_panel(Panel(df, freq=12, base_freq=4), f"file://{tmp_path}/p", {"x": "alias"})
    p = load_panel(spark, f"file://{tmp_path}/p")
    assert (p.freq, p.base_freq, p.m) == (12, 4, 3) and p.df.collect() == df.collect()


def test_stream_sums(spark, tmp_path):
    from quantloom.streaming.partials import partial_sums

    ts = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, ts, 2.0), (1, ts, 3.0), (2, ts, 1.0)], "u long, ts timestamp, v double").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("u long, ts timestamp, v double").parquet(f"{tmp_path}/in")
    q = partial_sums(s, "u", "ts", "v").writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.n, r.s, r.ss) for r in spark.table("sums").collect()} == {(1, 2, 5.0, 13.0), (2, 1, 1.0, 1.0)}
