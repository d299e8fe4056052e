"""Characteristics from monthly stock data: id, date, prc, ret, retx, vol, shrout, cfacpr, cfacshr, exchcd, permco, hsiccd, cash_div, rf, mktrf, hml, smb_ff."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.cross import winsorize
from quantloom.operators.rolling import moment_columns, moments, running, solve

from .spec import Terms, above, create, div, flag, nonzero, nz, replaced


def prepare(t: Terms) -> list[dict[str, str]]:
    return [
        {"prc": "abs(prc)", "shrout": "shrout / 1000", "vol": "vol * 100 / case when exchcd = 3 and date <= date '2001-01-31' then 2.0 when exchcd = 3 and date <= date '2001-12-31' then 1.8 when exchcd = 3 and date <= date '2003-12-31' then 1.6 else 1.0 end"},
        {"me": "prc * shrout", "exret": "ret - rf"},
        {"me_company": "case when me is not null then sum(me) over (partition by date, permco) end"},
    ]


def formulas(t: Terms) -> dict[str, str]:
    L, D, G, R = t.L, t.D, t.G, t.R
    f = {
        "market_equity": "me", "_pa": div("prc", "cfacpr"), "_div": f"(ret - retx) * cfacpr * {L('_pa')} * shrout", "div12m_me": div(R("sum", "_div", 12), nonzero("me")), "_shr": "shrout * cfacshr", "chcsho_12m": G("_shr", 12),
        "_me60": L("me", 60), "_me12": L("me", 12), "_c60": t.cumret("ret", 60), "_c12": t.cumret("ret", 12),
        "eqnpo_60m": f"ln({above('me')} / {above('_me60')}) - ln(1 + case when _c60 > -1 then _c60 end)", "eqnpo_12m": f"{'-1 * ' if t.jkp else ''}(ln({above('me')} / {above('_me12')}) - ln(1 + case when _c12 > -1 then _c12 end))",
        "ret_1_0": "ret", **{f"ret_{i}_{j}": t.cumret("ret", i, j) for i, j in ((3, 1), (6, 1), (9, 1), (12, 1), (12, 6), (36, 12), (60, 12))},
        "_c6": t.cumret("ret", 6), "_sic2": "floor(hsiccd / 100)", "indmom": div("sum(_c6 * me) over (partition by date, _sic2)", "sum(case when _c6 is not null then me end) over (partition by date, _sic2)"),
        "beta_60m": f"case when count(case when mktrf is not null then exret end) {t.frame(60)} >= 36 then regr_slope(exret, mktrf) {t.frame(60)} end", "price": "prc", "chmom": D("_c6", 6),
        "_cd": nz("cash_div"), "_cd24": R("sum", "_cd", 24, None, 1), "_init": flag("_cd > 0 and _cd24 = 0"), "divi": flag(f"{R('sum', '_init', 6)} > 0"), **{f"_cd_{k}": L("_cd", k) for k in (3, 6, 9, 12, 15, 18, 24)},
        "_omit": flag("_cd = 0 and ((_cd_3 > 0 and _cd_6 > 0 and _cd_9 > 0 and _cd_12 > 0 and _cd_15 > 0 and _cd_18 > 0) or (_cd_3 = 0 and _cd_6 > 0 and _cd_9 = 0 and _cd_12 > 0 and _cd_15 = 0 and _cd_18 > 0) or (_cd_3 = 0 and _cd_6 = 0 and _cd_9 = 0 and _cd_12 > 0 and _cd_15 = 0 and _cd_18 = 0 and _cd_24 > 0))"), "divo": flag(f"{R('sum', '_omit', 2)} > 0"),
        "_dv": f"ln({above('vol * prc')})", "dolvol": L("_dv"), "turn": div(R("mean", "vol", 3), "shrout * 1000"), "ipo": flag(f"row_number() {t.over} <= 12"),
    }
    for a, b in ((1, 1), (2, 5), (6, 10), (11, 15), (16, 20)):
        years, name = range(a, b + 1), f"{a}_{b}"
        f[f"_an_{name}"] = " + ".join(L("ret", 12 * y - 1) for y in years)
        f[f"seas_{name}an"] = f"_an_{name} / {len(years)}"
        f[f"seas_{name}na"] = f"({R('sum', 'ret', 12 * len(years), None, 12 * (a - 1))} - _an_{name}) / 11 / {len(years)}"
    return f


def prepared(df: DataFrame, t: Terms = Terms()) -> DataFrame:
    """df with what the characteristics take; under jkp the excess return is winsorised at a thousandth of the whole panel on both sides."""
    out = replaced(df, prepare(t))
    return winsorize(out, "exret", (0.001, 0.001), "exret", []) if t.jkp else out


def characteristics(df: DataFrame, wanted: list[str] | None = None, t: Terms = Terms()) -> DataFrame:
    return create(prepared(df, t), formulas(t), wanted)


#: Months whose residuals count, without the newest of them.
_HORIZONS = (6, 12)


def residual_momentum(df: DataFrame, factors: tuple[str, ...] = ("mktrf", "hml", "smb_ff"), window: int = 36, least: int = 24) -> DataFrame:
    """id, date, resff3_6_1, resff3_12_1: mean over deviation of the last residuals, without the newest, of rolling regressions.

    The regressions come from running sums, and so do their residuals' mean and deviation: both are forms of the sums over the last
    months with all values. A month without all values has those of the month before it.
    """
    cols = ["exret", *factors]
    k, by_id = len(cols), W.partitionBy("id").orderBy("date")
    rows = moments(df.select("id", "date", *cols), ["id"], "date", cols, window, "_m")
    full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))
    value = lambda i: F.when(full, F.col(cols[i]).cast("double") - F.col(f"_mo{i}"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    terms = {**{f"s{i}": value(i) for i in range(k)}, **{f"p{i}_{j}": value(i) * value(j) for i, j in pairs}}
    rows = running(rows, {f"_c{x}": v for x, v in terms.items()}, ["id"], "date").withColumn("_full", full)
    within = W.partitionBy("id", "_full").orderBy("date")
    before = lambda x, n: F.coalesce(F.lag(f"_c{x}", n).over(within), F.lit(0.0))
    recent = F.struct(*((before(x, 1) - before(x, h)).alias(f"h{h}{x}") for h in _HORIZONS for x in terms))
    rows = rows.withColumn("_h", recent).withColumn("_h", F.last(F.when(F.col("_full"), F.col("_h")), ignorenulls=True).over(by_id))
    sums = rows.select("id", "date", *moment_columns(k, "_m"), "_h.*")
    names = [f"resff3_{h}_1" for h in _HORIZONS]

    def run(batches):
        for pdf in batches:
            b = solve(pdf, k, "_m", least)[0][:, 1:]
            w = np.column_stack([np.ones(len(b)), -b])  # a residual's weights
            out = pdf[["id", "date"]].copy()
            n = np.maximum(pdf["_mn"].to_numpy(float), 1)
            level = (w * np.stack([pdf[f"_ms{i}"].to_numpy(float) for i in range(k)], 1)).sum(1) / n
            for h, name in zip(_HORIZONS, names):
                total = (w * np.stack([pdf[f"h{h}s{i}"].to_numpy(float) for i in range(k)], 1)).sum(1)
                square = sum((1 + (i != j)) * w[:, i] * w[:, j] * pdf[f"h{h}p{i}_{j}"].to_numpy(float) for i, j in pairs)
                variance = (square - total**2 / (h - 1)) / (h - 2)
                some = variance > 1e-12 * square
                out[name] = np.where(some, (total / (h - 1) - level) / np.sqrt(np.where(some, variance, 1)), np.nan)
            yield out

    kinds = dict(df.dtypes)
    out = sums.mapInPandas(run, f"id {kinds['id']}, date date, " + ", ".join(f"{c} double" for c in names))
    return out.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in names})
