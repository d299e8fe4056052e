"""Monthly characteristics from daily stock data: id, date, prc, bidlo, askhi, ret, vol, shrout, cfacpr, exchcd, rf (monthly), factors.

Daily rows become sums per id and month once; longer windows are ranges of months over these sums, so a five-year window is sixty
rows. Regressions are solved from sums of products, batches of ids and months at a time.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.analytics import grouped_ols
from quantloom.operators.rolling import moment_columns, moments, running, solve, window_sum

from .spec import Terms, above, create, div, replaced


def prepare(t: Terms) -> list[dict[str, str]]:
    return [
        {"prc": "abs(prc)", "shrout": "shrout / 1000", "vol": "vol / case when exchcd = 3 and date <= date '2001-01-31' then 2.0 when exchcd = 3 and date <= date '2001-12-31' then 1.8 when exchcd = 3 and date <= date '2003-12-31' then 1.6 else 1.0 end", "mon": "cast((year(date) - 1900) * 12 + month(date) as bigint)"},
        {"prc_adj": div("prc", "cfacpr"), "bidlo_adj": div("bidlo", "cfacpr"), "askhi_adj": div("askhi", "cfacpr"), "me": "prc * shrout", "dvol": "prc * vol", "turnover_d": div("vol", "shrout * 1e6"), "exret": "case when sum(case when ret = 0 then 1 else 0 end) over (partition by id, mon) < 10 then ret - rf / 21 end"},
        {"_x3": t.R("mean", "exret", 3), "_m3": t.R("mean", "mktrf", 3), **_spread_inputs(t)},
        {"_lo": _ladder("lo"), "_hi": _ladder("hi")},
        {"_lo": "case when _lo <> 0 and _hi / _lo > 8 then null else _lo end", "_hi": "case when _lo <> 0 and _hi / _lo > 8 then null else _hi end"},
        {"_p1": t.L("prc"), "_lo1": t.L("_lo"), "_hi1": t.L("_hi")},
        {"_lot": "case when _p1 < _lo and _p1 > 0 then _p1 when _p1 > _hi and _p1 > 0 then _lo + _p1 - _hi else _lo end", "_hit": "case when _p1 < _lo and _p1 > 0 then _hi - _lo + _p1 when _p1 > _hi and _p1 > 0 then _p1 else _hi end"},
        {"_h2": "case when _hit >= _hi1 then _hit when _hi1 > _hit then _hi1 end", "_l2": "case when _lot <= _lo1 then _lot when _lo1 < _lot then _lo1 end"},
        {"_beta": "case when _lot > 0 and _lo1 > 0 and _hit > 0 and _hi1 > 0 then power(ln(_hit / _lot), 2) + power(ln(_hi1 / _lo1), 2) end", "_gamma": "case when _l2 > 0 and _h2 > 0 then power(ln(_h2 / _l2), 2) end"},
        {"_alpha": f"(sqrt(2.0) - 1) * sqrt(_beta) / {3 - 2 * 2**0.5!r} - sqrt(_gamma / {3 - 2 * 2**0.5!r})"},
        {"_spread": "case when _alpha is not null then greatest(2 * (exp(_alpha) - 1) / (1 + exp(_alpha)), 0) end"},
    ]


def _spread_inputs(t: Terms) -> dict[str, str]:
    # The pair of the last day with a valid low and high, this day included.
    run = "over (partition by id order by date rows between unbounded preceding and current row)"
    valid = "0 < bidlo_adj and bidlo_adj < askhi_adj"
    return {"_lo0": f"max_by(case when {valid} then bidlo_adj end, case when {valid} then date end) {run}", "_hi0": f"max_by(case when {valid} then askhi_adj end, case when {valid} then date end) {run}"}


def _ladder(side: str) -> str:
    own = {"lo": "bidlo_adj", "hi": "askhi_adj"}[side]
    below = {"lo": "prc_adj", "hi": "_hi0 - _lo0 + prc_adj"}[side]
    over = {"lo": "_lo0 + prc_adj - _hi0", "hi": "prc_adj"}[side]
    return f"case when 0 < bidlo_adj and bidlo_adj < askhi_adj then {own} when _lo0 <= prc_adj and prc_adj <= _hi0 then _{side}0 when prc_adj < _lo0 then {below} when prc_adj > _hi0 then {over} else {own} end"


def monthly_sums(daily: str) -> str:
    """SQL of one row per id and month, from prepared daily rows."""
    both, down = "exret is not null and mktrf is not null", "exret is not null and mktrf < 0"
    three, traded = "_x3 is not null and _m3 is not null", "ret is not null"
    s = lambda cond, x: f"sum(case when {cond} then {x} end)"
    n = lambda cond: f"sum(case when {cond} then 1 else 0 end)"
    cols = {
        "date": "last_day(max(date))", "n_ret": "count(ret)", "retvol": "stddev_samp(ret)", "rmax1_21d": "max(ret)", "_r1": "sum(ret)", "_r2": "sum(ret * ret)", "_r3": "sum(ret * ret * ret)", "n_days": "count(*)",
        "std_turn": f"stddev_samp({div('vol', 'shrout')})", "std_dolvol": f"stddev_samp(ln({above('dvol')}))", "bidaskhl_21d": "avg(_spread)", "baspread": f"avg({div('askhi - bidlo', '0.5 * (askhi + bidlo)')})",
        "_zero": n("vol = 0"), "_tn": "count(turnover_d)", "_ts": "sum(turnover_d)", "_tss": "sum(turnover_d * turnover_d)", "_an": n(f"{traded} and dvol <> 0"), "_as": s(f"{traded} and dvol <> 0", "abs(ret) / nullif(dvol, 0)"), "_dn": n(f"{traded} and dvol is not null"), "_drn": n(traded), "_ds": s(traded, "dvol"), "_dss": s(traded, "dvol * dvol"),
        "_en": n(both), "_ey": s(both, "exret"), "_ex": s(both, "mktrf"), "_eyy": s(both, "exret * exret"), "_exx": s(both, "mktrf * mktrf"), "_exy": s(both, "exret * mktrf"), "_wn": n(down), "_wy": s(down, "exret"), "_wx": s(down, "mktrf"), "_wxx": s(down, "mktrf * mktrf"), "_wxy": s(down, "exret * mktrf"),
        "_pn": "count(prc_adj)", "_pmax": "max(prc_adj)", "_plast": "max_by(prc_adj, date)", "_cn": n(three), "_cy": s(three, "_x3"), "_cx": s(three, "_m3"), "_cyy": s(three, "_x3 * _x3"), "_cxx": s(three, "_m3 * _m3"), "_cxy": s(three, "_x3 * _m3"),
    }
    return f"select id, mon, {', '.join(f'{v} as {k}' for k, v in cols.items())} from {daily} t group by id, mon"


def formulas() -> dict[str, str]:
    w = lambda k: f"over (partition by id order by mon range between {k - 1} preceding and current row)"
    total = lambda x, k: f"sum({x}) {w(k)}"
    f = {
        "_m1": div("_r1", "n_ret"), "_cm2": "_r2 / nullif(n_ret, 0) - _m1 * _m1", "rskew_21d": "case when n_ret >= 3 and _cm2 > 1e-18 then (_r3 / n_ret - 3 * _m1 * _r2 / n_ret + 2 * _m1 * _m1 * _m1) / power(_cm2, 1.5) * sqrt(n_ret * (n_ret - 1.0)) / (n_ret - 2) end",
        "zero_trades_21d": "case when _tn > 0 then (_zero + case when _ts = 0 then 0 else 1 / nullif(_ts, 0) / 480000 end) * 21 / nullif(_tn, 0) end",
    }
    for k, days, least in ((6, 126, 60), (12, 252, 120)):
        f |= {f"_z{k}": total("_zero", k), f"_tn{k}": total("_tn", k), f"_ts{k}": total("_ts", k)}
        f[f"zero_trades_{days}d"] = f"case when _tn{k} >= {least} then (_z{k} + case when _ts{k} = 0 then 0 else 1 / nullif(_ts{k}, 0) / 11000 end) * {days} / nullif(_tn{k}, 0) end"
    dev = lambda n, s, ss: f"sqrt(greatest(0, {ss} - {s} * {s} / nullif({n}, 0)) / nullif({n} - 1, 0))"
    f |= {
        "_tss6": total("_tss", 6), "turnover_126d": "case when _tn6 >= 60 then _ts6 / nullif(_tn6, 0) end", "turnover_var_126d": f"{dev('_tn6', '_ts6', '_tss6')} / nullif(turnover_126d, 0)",
        "_an6": total("_an", 6), "_as6": total("_as", 6), "_dn6": total("_dn", 6), "_drn6": total("_drn", 6), "_ds6": total("_ds", 6), "_dss6": total("_dss", 6), "_ok6": "_drn6 >= 60 and _an6 > 0",
        "ami_126d": "case when _ok6 then 1e6 * _as6 / nullif(_an6, 0) end", "dolvol_126d": "case when _ok6 then _ds6 / nullif(_dn6, 0) end", "dolvol_var_126d": f"{dev('_dn6', '_ds6', '_dss6')} / nullif(dolvol_126d, 0)",
        **{f"{x}12": total(x, 12) for x in ("_en", "_ey", "_ex", "_eyy", "_exx", "_exy", "_wn", "_wy", "_wx", "_wxx", "_wxy", "_pn")}, "_pmax12": f"max(_pmax) {w(12)}",
        "_syy": "_eyy12 - _ey12 * _ey12 / nullif(_en12, 0)", "_sxx": "_exx12 - _ex12 * _ex12 / nullif(_en12, 0)", "_sxy": "_exy12 - _ex12 * _ey12 / nullif(_en12, 0)",
        "rvol_252d": "case when _en12 >= 120 then sqrt(greatest(0, _syy) / nullif(_en12 - 1, 0)) end", "_mktvol": "case when _en12 >= 120 then sqrt(greatest(0, _sxx) / nullif(_en12 - 1, 0)) end", "ivol_capm_252d": "case when _en12 >= 120 then sqrt(greatest(0, _syy - _sxy * _sxy / nullif(_sxx, 0)) / nullif(_en12 - 1, 0)) end",
        "betadown_252d": "case when _en12 >= 120 and _wn12 >= 60 then (_wxy12 - _wx12 * _wy12 / nullif(_wn12, 0)) / nullif(_wxx12 - _wx12 * _wx12 / nullif(_wn12, 0), 0) end", "prc_highprc_252d": "case when _pn12 >= 120 then _plast / nullif(_pmax12, 0) end",
        **{f"{x}60": total(x, 60) for x in ("_cn", "_cy", "_cx", "_cyy", "_cxx", "_cxy")},
        "_cvy": "_cyy60 - _cy60 * _cy60 / nullif(_cn60, 0)", "_cvx": "_cxx60 - _cx60 * _cx60 / nullif(_cn60, 0)", "corr_1260d": "case when _cn60 >= 750 and _cvy > 0 and _cvx > 0 then (_cxy60 - _cx60 * _cy60 / nullif(_cn60, 0)) / sqrt(_cvy * _cvx) end", "betabab_1260d": "corr_1260d * rvol_252d / nullif(_mktvol, 0)",
    }
    return f


DIRECT = ["retvol", "rmax1_21d", "std_turn", "std_dolvol", "bidaskhl_21d", "baspread"]


def characteristics(daily: DataFrame, wanted: list[str] | None = None, t: Terms = Terms()) -> DataFrame:
    """id, mon, date (month end) and the characteristics that need no residuals and no week."""
    spark = daily.sparkSession
    sums = spark.sql(monthly_sums("{daily}"), daily=replaced(daily, prepare(t)))
    out = create(sums, formulas(), wanted)
    names = wanted or [*DIRECT, *(k for k in formulas() if not k.startswith("_"))]
    return out.select("id", "mon", "date", *names)


def five_largest(daily: DataFrame) -> DataFrame:
    """id, mon, rmax5_21d: mean of a month's five largest returns; null for five rows or fewer. A month of an id is a few dozen rows."""
    top = F.slice(F.sort_array(F.collect_list("ret"), asc=False), 1, 5)
    return daily.groupBy("id", "mon").agg(F.when(F.count("*") > 5, F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).alias("rmax5_21d"))


def largest_to_volatility(daily: DataFrame, t: Terms = Terms()) -> DataFrame:
    """id, mon, date, rmax5_rvol_21d: rmax5_21d over a year's volatility of excess returns."""
    largest = five_largest(replaced(daily, prepare(t)))
    return characteristics(daily, ["rvol_252d"], t).join(largest, ["id", "mon"], "left").select("id", "mon", "date", (F.col("rmax5_21d") / F.nullif("rvol_252d", F.lit(0.0))).alias("rmax5_rvol_21d"))


def _indices(k: int, degree: int) -> list[tuple[int, ...]]:
    return list(combinations_with_replacement(range(k), degree))


def _where_full(columns: list[str], prefix: str, rows: str = "true") -> dict[str, Column]:
    """The columns as prefix0, prefix1, ..., null in rows in which one of them is null, or for which `rows` doesn't hold."""
    full = " and ".join([rows, *(f"{c} is not null" for c in columns)])
    return {f"{prefix}{i}": F.expr(f"case when {full} then cast({c} as double) end") for i, c in enumerate(columns)}


def _power_sums(k: int, prefix: str, degree: int) -> list[Column]:
    """Aggregates of such columns: their number as prefix_n, and the sums of their products up to a degree, named by the factors."""
    products = [at for d in range(1, degree + 1) for at in _indices(k, d)]
    sums = (f"sum({' * '.join(f'{prefix}{i}' for i in at)}) as {prefix}_{'_'.join(map(str, at))}" for at in products)
    return [F.expr(x) for x in (f"count({prefix}0) as {prefix}_n", *sums)]


def _central(pdf: pd.DataFrame, k: int, prefix: str, degree: int) -> tuple[np.ndarray, ...]:
    """n, and the central second moments' sums and, for degree 3, the third ones', as arrays by row."""
    get = lambda *at: pdf["_".join([prefix, *map(str, sorted(at))])].to_numpy(float)
    n = pdf[f"{prefix}_n"].to_numpy(float)
    some, rows = np.where(n > 0, n, np.nan), len(pdf)
    s, p = np.stack([get(i) for i in range(k)], 1), np.empty((rows, k, k))
    for i, j in _indices(k, 2):
        p[:, i, j] = p[:, j, i] = get(i, j)
    m = s / some[:, None]
    second = p - m[:, :, None] * s[:, None, :]
    if degree < 3:
        return n, second
    third = np.empty((rows, k, k, k))
    for at in _indices(k, 3):
        i, j, l = at
        v = get(*at) - m[:, i] * p[:, j, l] - m[:, j] * p[:, i, l] - m[:, l] * p[:, i, j] + 2 * m[:, i] * m[:, j] * s[:, l]
        for a in set(permutations(at)):
            third[(slice(None), *a)] = v
    return n, second, third


def _slopes(second: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Slopes of the first variable on the others, NaN where `rows` is false or they are collinear."""
    out = np.full((len(second), second.shape[1] - 1), np.nan)
    d = np.sqrt(np.maximum(np.einsum("rii->ri", second)[:, 1:], 0))
    at = np.flatnonzero(rows & (d > 0).all(1))
    r = second[at, 1:, 1:] / (d[at][:, :, None] * d[at][:, None, :])
    fine = np.linalg.eigvalsh(r)[:, 0] > 1e-11 if len(at) else np.zeros(0, bool)
    at, r = at[fine], r[fine]
    if len(at):
        out[at] = np.linalg.solve(r, (second[at, 1:, 0] / d[at])[:, :, None])[:, :, 0] / d[at]
    return out


#: Regressors by model.
RESIDUAL_MODELS = {"capm": ["mktrf"], "ff3": ["mktrf", "hml", "smb_ff"], "hxz4": ["mktrf", "smb_hxz", "inv", "roe"]}


def residual_statistics(daily: DataFrame, models: dict[str, list[str]] = RESIDUAL_MODELS, least: int = 15) -> DataFrame:
    """id, mon, ivol_<model>_21d, iskew_<model>_21d, coskew_21d, beta_dimson_21d of prepared daily rows.

    A residual is a linear form of the variables, so its second and third moments are forms of theirs: one aggregate by id and month
    has the sums of all products up to the third degree, and months are solved a batch at a time. A month's days never meet in a task.
    """
    if missing := sorted({c for v in models.values() for c in v} - set(daily.columns)):
        raise ValueError(f"no such factors: {', '.join(missing)}")
    by_id = W.partitionBy("id").orderBy("date")
    cols = sorted({"exret", "mktrf", *(c for v in models.values() for c in v)})
    rows = daily.select("id", "date", "mon", *cols).withColumns({"_lag": F.lag("mktrf").over(by_id), "_lead": F.lead("mktrf").over(by_id), "_next": F.lead("mon").over(by_id)})
    sizes = {m: 1 + len(xs) for m, xs in models.items()}
    values = {k: v for m, xs in models.items() for k, v in _where_full(["exret", *xs], m).items()}
    values |= _where_full(["exret", "mktrf", "_lag", "_lead"], "dimson", "_next <=> mon")  # the last day's lead is next month's
    sums = [x for m, k in sizes.items() for x in _power_sums(k, m, 3)] + _power_sums(4, "dimson", 2)
    by_month = rows.select("id", "mon", *(v.alias(k) for k, v in values.items())).groupBy("id", "mon").agg(*sums)
    names = [f"{k}_{m}_21d" for m in models for k in ("ivol", "iskew")] + ["coskew_21d", "beta_dimson_21d"]

    def run(batches):
        for pdf in batches:
            out = pdf[["id", "mon"]].copy()
            for m, k in sizes.items():
                n, second, third = _central(pdf, k, m, 3)
                b = _slopes(second, n >= least)
                w = np.column_stack([np.ones(len(b)), -b])  # the residual's weights
                m2, m3 = np.einsum("ri,rj,rij->r", w, w, second) / n, np.einsum("ri,rj,rl,rijl->r", w, w, w, third) / n
                flat = ~(m2 > 1e-12 * second[:, 0, 0] / n)
                m2 = np.where(flat, np.where(np.isnan(m2), np.nan, 0), m2)
                safe = np.where(flat, np.nan, m2)
                out[f"ivol_{m}_21d"] = np.sqrt(m2 * n / (n - 1))
                out[f"iskew_{m}_21d"] = m3 / safe**1.5 * np.sqrt(n * (n - 1)) / (n - 2)
                if m == "capm":
                    out["coskew_21d"] = (third[:, 0, 1, 1] - b[:, 0] * third[:, 1, 1, 1]) / n / (np.sqrt(safe) * second[:, 1, 1] / n)
            n, second = _central(pdf, 4, "dimson", 2)
            out["beta_dimson_21d"] = _slopes(second, n >= least).sum(1)
            yield out.reindex(columns=["id", "mon", *names])

    kinds = dict(daily.dtypes)
    out = by_month.mapInPandas(run, f"id {kinds['id']}, mon long, " + ", ".join(f"{n} double" for n in names))
    return out.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in names})


def weekly(daily: DataFrame, window: int = 156, least: int = 52, lags: int = 4) -> DataFrame:
    """id, mon, beta, betasq, idiovol, pricedelay, pricedelay_slope of weekly returns on their equal-weight mean; the month's last week.

    Both regressions, on the week's market return and on its lags too, are solved from running sums, a batch of rows at a time.
    """
    week = F.extract(F.lit("YEAROFWEEK"), F.col("date")) * 100 + F.weekofyear("date")
    ret = daily.groupBy("id", week.alias("yw")).agg(F.expm1(F.sum(F.log1p("ret"))).alias("y"), F.max("mon").alias("mon"))
    market = ret.groupBy("yw").agg(F.avg("y").alias("x0"))
    by_id = W.partitionBy("id").orderBy("yw")
    ret = ret.join(market, "yw").withColumns({f"x{k}": F.lag("x0", k).over(by_id) for k in range(1, lags + 1)})
    sizes = {"_a": 2, "_b": lags + 2}
    ret = moments(ret, ["id"], "yw", ["y", "x0"], window, "_a")
    ret = moments(ret, ["id"], "yw", ["y", *(f"x{k}" for k in range(lags + 1))], window, "_b")
    last = F.row_number().over(W.partitionBy("id", "mon").orderBy(F.desc("yw")))
    rows = ret.withColumn("_last", last).where("_last = 1").select("id", "mon", *(c for x, k in sizes.items() for c in moment_columns(k, x)))
    names = ["beta", "betasq", "idiovol", "pricedelay", "pricedelay_slope"]
    kinds = dict(daily.dtypes)

    def run(batches):
        for pdf in batches:
            one, r2, ivol = solve(pdf, sizes["_a"], "_a", least)
            many, all_r2, _ = solve(pdf, sizes["_b"], "_b", least)
            with np.errstate(divide="ignore", invalid="ignore"):
                delay = 1 - r2 / np.where(all_r2 != 0, all_r2, np.nan)
                slope = (many[:, 2:] * np.arange(1, lags + 1)).sum(1) / many[:, 1:].sum(1)
            yield pdf[["id", "mon"]].assign(beta=one[:, 1], betasq=one[:, 1] ** 2, idiovol=ivol, pricedelay=delay, pricedelay_slope=slope)

    out = rows.mapInPandas(run, f"id {kinds['id']}, mon long, " + ", ".join(f"{n} double" for n in names))
    return out.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in names})


def trend_factor(daily: DataFrame, days: tuple[int, ...] = (1, 3, 5, 10, 20, 50, 100, 200, 400, 600, 800, 1000)) -> DataFrame:
    """id, mon, trend_factor: fitted return from normalised moving averages at the month's end and the mean of twelve months' coefficients.

    All averages come from one running sum of prices, and only a month's last row has them made into numbers.
    """
    rows = running(daily, {"_pn": F.col("prc_adj").isNotNull().cast("long"), "_ps": F.col("prc_adj").cast("double")}, ["id"], "date")
    avg = {f"a{k}": F.when(window_sum("_pn", k, ["id"], "date") == k, window_sum("_ps", k, ["id"], "date") / k / F.col("prc_adj")) for k in days}
    names = list(avg)
    rows = rows.withColumns(avg)
    ends = rows.groupBy("id", "mon").agg(F.expm1(F.sum(F.log1p("ret"))).alias("ret"), F.max_by(F.struct(*names), "date").alias("a")).select("id", "mon", "ret", "a.*")
    by_mon = W.partitionBy("id").orderBy("mon")
    fit = ends.select("mon", "ret", *(F.lag(a).over(by_mon).alias(a) for a in names))
    betas = grouped_ols(fit, ["mon"], "ret", names, constant=False, least=len(names))
    year = W.orderBy("mon").rowsBetween(-11, 0)  # one row for each month
    mean = betas.select("mon", *(F.when(F.count(f"b_{a}").over(year) == 12, F.avg(f"b_{a}").over(year)).alias(f"m_{a}") for a in names))
    value = sum((F.col(a) * F.col(f"m_{a}") for a in names), F.lit(0.0))
    return ends.join(mean, "mon", "left").select("id", "mon", value.alias("trend_factor"))
