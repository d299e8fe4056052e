"""Rolling regressions from running sums, against numpy on the windows themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import rolling
from quantloom.operators.panel import Panel


def panel(rows=90, k=4, seed=1, drift=0.0):
    r, out = np.random.default_rng(seed), []
    for i in range(4):
        x = r.normal(size=(rows - 7 * i, k)) + 50 * i + drift * np.arange(rows - 7 * i)[:, None]
        y = x @ np.arange(1, k + 1) / 10 + r.normal(size=len(x)) + 3
        d = pd.DataFrame(np.column_stack([y, x]), columns=["y", *(f"x{j}" for j in range(k))])
        d[r.random(d.shape) < 0.04] = np.nan
        d.insert(0, "date", pd.date_range("2000-01-31", periods=len(d), freq="ME"))
        d.insert(0, "id", i)
        out.append(d)
    return pd.concat(out)


def plain(g, xs, n, least, constant, step=1):
    """What each window gives, by least squares on its rows."""
    v, out = g[["y", *xs]].to_numpy(float), []
    for i in range(len(v)):
        w = v[max(i % step, i - (n - 1) * step) : i + 1 : step]
        w = w[~np.isnan(w).any(1)]
        a = np.column_stack([np.ones(len(w)), w[:, 1:]]) if constant else w[:, 1:]
        if len(w) < max(least, a.shape[1]) or np.linalg.matrix_rank(a) < a.shape[1]:
            out.append([np.nan] * (a.shape[1] + 2))
            continue
        b = np.linalg.lstsq(a, w[:, 0], rcond=None)[0]
        e = w[:, 0] - a @ b
        out.append([*b, 1 - (e**2).sum() / ((w[:, 0] - w[:, 0].mean()) ** 2).sum(), e.std(ddof=1)])
    return np.array(out)


def spark_panel(spark, df, **kw):
    s = spark.createDataFrame(df)
    return Panel(s.select("id", F.to_date("date").alias("date"), *(F.nullif(F.col(c), F.lit(float("nan"))).alias(c) for c in df.columns[2:])), **kw)


@pytest.mark.parametrize(("k", "n", "least", "constant", "drift"), [(2, 24, 12, True, 0), (4, 36, None, True, 0), (4, 24, 8, False, 0), (1, 12, 3, True, 0), (2, 24, 12, True, 1.0)])
def test_windows_agree_with_numpy(spark, k, n, least, constant, drift):
    df, xs = panel(k=k, drift=drift), [f"x{j}" for j in range(k)]
    got = rolling.rolling_regression(spark_panel(spark, df), "y", xs, n, least, constant).toPandas().sort_values(["id", "date"])
    for i, g in df.groupby("id"):
        want, have = plain(g, xs, n, least or n, constant), got[got["id"] == i].iloc[:, 2:].to_numpy(float)
        assert np.array_equal(np.isnan(want), np.isnan(have)), i
        assert np.allclose(want, have, rtol=1e-8, atol=1e-8, equal_nan=True), i
    assert least is None or got["r2"].notna().any()


def test_phases_of_a_base_period(spark):
    df = panel(k=1).drop(columns=[]).reset_index(drop=True)
    got = rolling.rolling_regression(spark_panel(spark, df, freq=12, base_freq=4), "y", ["x0"], 10, 5).toPandas().sort_values(["id", "date"])
    for i, g in df.groupby("id"):
        assert np.allclose(plain(g, ["x0"], 10, 5, True, 3), got[got["id"] == i].iloc[:, 2:].to_numpy(float), rtol=1e-8, equal_nan=True), i


def test_collinear_and_constant_regressors_give_nothing(spark):
    df = panel(k=2)
    df["x1"] = 2 * df["x0"] + 1
    assert rolling.rolling_regression(spark_panel(spark, df), "y", ["x0", "x1"], 24, 12).where("r2 is not null or ivol is not null or b_x0 is not null").count() == 0
    df["x1"] = 7.0
    assert rolling.rolling_regression(spark_panel(spark, df), "y", ["x0", "x1"], 24, 12).where("const is not null").count() == 0
    df["y"] = 5.0  # nothing to explain
    flat = rolling.rolling_regression(spark_panel(spark, df), "y", ["x0"], 24, 12).where("const is not null")
    assert flat.where("r2 is null and abs(b_x0) < 1e-9 and abs(const - 5) < 1e-9").count() == flat.count() > 0


def test_empty_and_short_panels(spark):
    df = panel(k=2)
    p = spark_panel(spark, df)
    assert rolling.rolling_regression(p.of(p.df.where("false")), "y", ["x0", "x1"], 24).count() == 0
    short = rolling.rolling_regression(p.of(p.df.where("date < '2000-05-01'")), "y", ["x0", "x1"], 24).collect()
    assert short and all(r.const is None for r in short)
