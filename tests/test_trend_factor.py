"""The registered trend factor, with its twelve moving averages, against numpy."""

import os

import numpy as np
import pytest

from quantloom.plans import charqueries as cq

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
DAYS = (1, 3, 5, 10, 20, 50, 100, 200, 400, 600, 800, 1000)


def test_twelve_windows_agree_with_numpy(spark):
    got = {(r.id, r.mon): r.trend_factor for r in cq.QUERIES["crspd_trend_factor"](spark, SF).collect()}
    daily = cq._prepared(spark, SF).selectExpr("id", "date", "mon", "cast(prc_adj as double) as p", "ret").toPandas().sort_values(["id", "date"])
    assert daily["id"].nunique() > 20
    rows, ends = [], {}
    for i, g in daily.groupby("id"):
        before = None
        a = np.stack([(g["p"].rolling(k).mean() / g["p"]).to_numpy() for k in DAYS], 1)
        g = g.reset_index(drop=True)
        for mon, m in g.groupby("mon"):
            r = np.expm1(np.log1p(m["ret"].dropna().astype(float)).sum()) if m["ret"].notna().any() else np.nan
            if before is not None:
                rows.append((mon, r, before))
            before = ends[i, mon] = a[m.index[-1]]
    betas = {}
    for mon in sorted({x[0] for x in rows}):
        here = [(y, x) for k, y, x in rows if k == mon and np.isfinite(y) and np.isfinite(x).all()]
        if len(here) >= len(DAYS):  # as many rows as coefficients will do
            betas[mon] = np.linalg.lstsq(np.array([x for _, x in here]), np.array([y for y, _ in here]), rcond=None)[0]
    have = [(k, v) for k, v in got.items() if v is not None and np.isfinite(v)]
    assert len(have) > 100
    checked = 0
    for (i, mon), v in have:
        year = [betas[m] for m in range(mon - 11, mon + 1) if m in betas]
        if len(year) == 12:
            checked += 1
            assert np.isclose(v, ends[i, mon] @ np.mean(year, 0), rtol=1e-4, atol=1e-6), (i, mon)
    assert checked > 100
