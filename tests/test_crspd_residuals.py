"""Daily characteristics that the registered queries must yield: residuals of all ids against numpy, five largest returns to volatility."""

import os

import numpy as np
import pytest

from quantloom.plans import charqueries as cq
from quantloom.plans import crspd, crspm

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def fit(y, x):
    a = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    return b, y - a @ b


def of_month(g):
    """The statistics of one id's month, from its days."""
    out = {}
    for m, xs in crspd.RESIDUAL_MODELS.items():
        d = g[["exret", *xs]].dropna().to_numpy()
        if len(d) < 15:
            continue
        b, e = fit(d[:, 0], d[:, 1:])
        n = len(e)
        out[f"ivol_{m}_21d"] = e.std(ddof=1)
        out[f"iskew_{m}_21d"] = (e**3).mean() / (e**2).mean() ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2)
        if m == "capm":
            x = d[:, 1] - d[:, 1].mean()
            out["coskew_21d"] = (e * x**2).mean() / np.sqrt((e**2).mean()) / (x**2).mean()
    d = g[["exret", "mktrf", "lag", "lead"]].iloc[:-1].dropna().to_numpy()
    if len(d) >= 15:
        out["beta_dimson_21d"] = fit(d[:, 0], d[:, 1:])[0][1:].sum()
    return out


def test_residuals_of_all_ids_agree_with_numpy(spark):
    got = cq.QUERIES["crspd_residuals"](spark, SF).toPandas().set_index(["id", "mon"])
    daily = cq._prepared(spark, SF).selectExpr("id", "date", "mon", "exret", "mktrf", "hml", "smb_ff", *(f"{v} as {k}" for k, v in cq._Q_FACTORS.items())).toPandas().sort_values(["id", "date"]).drop(columns="date").astype(float)
    daily["lag"], daily["lead"] = daily.groupby("id")["mktrf"].shift(1), daily.groupby("id")["mktrf"].shift(-1)
    assert len(got) == daily.groupby(["id", "mon"]).ngroups
    seen = 0
    for key, g in daily.groupby(["id", "mon"]):
        want, have = of_month(g), got.loc[key]
        for c in got.columns:
            assert (c in want) == (not np.isnan(have[c])), (key, c)
            assert c not in want or np.isclose(have[c], want[c], rtol=1e-8, atol=1e-10), (key, c)
        seen += len(want) == 8
    assert seen > 1000


def test_missing_factors_raise(spark):
    with pytest.raises(ValueError, match="inv, roe, smb_hxz"):
        crspd.residual_statistics(cq._prepared(spark, SF))


def test_five_largest_to_volatility_is_there(spark):
    assert cq.QUERIES["crspd_rmax5_rvol"](spark, SF).where("rmax5_rvol_21d is not null").count()


def test_residual_momentum_agrees_with_numpy(spark):
    df = cq._stocks(spark, SF).selectExpr("id", "date", "case when (id + month(date)) % 11 <> 0 then exret end as exret", "mktrf", "hml", "case when id % 10 <> 3 or month(date) <> 5 then smb_ff end as smb_ff")
    got = crspm.residual_momentum(df).toPandas().sort_values(["id", "date"])
    rows = df.toPandas().sort_values(["id", "date"])
    some = sorted(rows["id"].unique())[:25]
    for i in some:
        v, have = rows.loc[rows["id"] == i, ["exret", "mktrf", "hml", "smb_ff"]].to_numpy(float), got.loc[got["id"] == i].iloc[:, 2:].to_numpy(float)
        for at in range(len(v)):
            w = v[max(0, at - 35) : at + 1]
            w = w[~np.isnan(w).any(1)]
            want = [np.nan, np.nan]
            if len(w) >= 24:
                _, e = fit(w[:, 0], w[:, 1:])
                want = [e[-n:-1].mean() / e[-n:-1].std(ddof=1) for n in (6, 12)]
            assert np.allclose(have[at], want, rtol=1e-7, atol=1e-9, equal_nan=True), (i, at)
    assert np.isfinite(got["resff3_12_1"]).any()
