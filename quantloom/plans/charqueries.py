"""Queries of the characteristics over accounting and stock panels derived from the tables at hand, with SQL for each.

The panels' columns are combinations of the tables' sums, with nulls at fixed places; they have the shape of the licensed data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators.panel import Panel

from . import crspd, crspm, factorqueries, factors, funda, fundq, ledgerqueries, linkqueries, merged, spanqueries  # noqa: F401 (those named queries register their own)
from .panels import PA, PM, frame, oracle
from .queries import QUERIES, rounded
from .queries import ORACLES
from .spec import Terms, create, levels, replaced, sql

_T = Terms()


def _items(names: list[str], salt: int = 0) -> str:
    """An amount for each name: a mix of the row's sums, negative and null at times."""
    out = []
    for i, n in enumerate(names, 1 + salt):
        a, b, c = ((i * 37) % 19 + 1) / 40, ((i * 53) % 23 - 8) / 50, (i * 29) % 13
        out.append(f"case when (id * {i % 7 + 1} + p * {i % 5 + 2} + {i}) % {11 + i % 9} <> 0 then ({a} * sale + {b} * net + {c} * qty) / 1000 end as {n}")
    return ", ".join(out)


_FUNDA = f"(select id, date, date as datadate, cast(year(date) as int) as fyear, cast(2000 + (ind * 173 + id % 4) % 5200 as varchar(9)) as sic, case when id % 9 = 0 then '713210' else '3254' end as naics, {_items(funda.RAW)} from (select *, cast(year(date) as int) as p from ({PA}) a) b)"
_FUNDA = _FUNDA.replace("varchar(9)", "string")
#: Quarters of fiscal years; those of a fifth of the ids end in June from 1996 on. Some year-to-date values are missing, and some quarters.
_QUARTERS = """(select *, sum(saleq) over (partition by id, fyearq order by date) as saley, case when id % 4 <> 1 then sum(cogsq) over (partition by id, fyearq order by date) end as cogsy
 from (select *, cast(case when id % 5 = 0 and date >= date '1996-03-01' then year(date) + cast(quarter(date) > 2 as int) else year(date) end as int) as fyearq, cast(case when id % 5 = 0 and date >= date '1996-03-01' then (quarter(date) + 1) % 4 + 1 else quarter(date) end as int) as fqtr
 from (select id, date, sale / 717 as saleq, case when (id + year(date)) % 6 <> 0 then net / 1717 end as cogsq, qty as atq, prc as prccq from ({0}) a where (id * 7 + year(date) * 4 + quarter(date)) % 19 <> 0) b) c)"""
_PQ = PM.replace("last_day(cast(l_shipdate as date))", "last_day(make_date(cast(year(l_shipdate) as int), cast(quarter(l_shipdate) * 3 as int), 1))")
_FUNDQ = f"(select id, date, {_items(fundq.RAW, 100)} from (select *, cast(year(date) * 4 + quarter(date) as int) as p from ({_PQ}) a) b)"
_STOCK = f"""(select id, date, case when (id + month(date)) % 13 <> 0 then -0.0091731 * prc else 0.0091731 * prc end as prc, ret, ret - case when month(date) % 3 = id % 3 then 0.002 else 0 end as retx, qty as vol, 1000.0 * (10 + id % 7 + cnt) as shrout,
 cast(1 + id % 2 as double) as cfacpr, cast(1 as double) as cfacshr, exchcd, ind as permco, cast(2000 + ind * 173 as double) as hsiccd, case when month(date) % 3 = id % 3 and id % 5 <> 0 then cast(0.25 as double) end as cash_div, cast(0.002 as double) as rf, avg(ret) over (partition by date) as mktrf,
 avg(case when ind % 2 = 0 then ret else -ret end) over (partition by date) as hml, avg(case when exchcd = 1 then ret else -ret end) over (partition by date) as smb_ff from ({PM}) a)"""
#: Ids grow with the table. Four suppliers are an id: one alone has some 600 days, and the longest moving average takes 1,000.
_DAILY = """(select id, date, prc, prc * (0.98 - 0.001 * (id % 3)) as bidlo, case when day(date) % 11 = 0 then prc * 0.97 else prc * 1.02 end as askhi, prc / lag(prc) over (partition by id order by date) - 1 as ret, vol, 1000.0 * (20 + id) as shrout, cast(1 as double) as cfacpr, cast(id % 3 + 1 as int) as exchcd, cast(0.002 as double) as rf,
 0.01 * sin(0.7 * (year(date) * 366 + dayofyear(date))) + 0.0005 as mktrf, 0.008 * cos(0.3 * (year(date) * 366 + dayofyear(date))) as hml, 0.006 * sin(1.9 * (year(date) * 366 + dayofyear(date))) as smb_ff
 from (select cast(floor(l_suppkey / 4) as bigint) as id, cast(l_shipdate as date) as date, 0.0091731 * round(sum(l_extendedprice), 2) / sum(l_quantity) as prc, case when sum(l_quantity) < 15 then 0 else sum(l_quantity) end as vol from {lineitem} group by cast(floor(l_suppkey / 4) as bigint), cast(l_shipdate as date)) a)"""


def _double_quoted(source: str) -> str:
    return source.replace(" as string)", " as varchar)")


def _register(prefix: str, source: str, columns: list[str], prepare, exprs: dict, group: int = 26, t: Terms = _T, only: list[str] | None = None) -> None:
    names = only or [k for k in exprs if not k.startswith("_")]
    for i in range(0, len(names), group):
        some = names[i : i + group]

        def run(spark, sf_dir, some=some):
            df = frame(spark, sf_dir, f"select * from {source} t")
            return rounded(create(replaced(df, prepare(t)), exprs, some).select("id", "date", *some), 5)

        key = f"{prefix}_{i // group + 1}"
        QUERIES[key] = run
        outer = ["id", "date", *(f"round({c}, 5) as {c}" if c not in _WHOLE else c for c in some)]
        ORACLES[key] = oracle(sql(_double_quoted(source), columns, [*prepare(t), *levels(exprs, some)], outer))


#: Characteristics that are whole numbers.
_WHOLE = {"f_score", "ps", "sin", "rd", "securedind", "convind", "ni_inc8q", "divi", "divo", "ipo", "age"}
_FUNDA_COLS = ["id", "date", "datadate", "fyear", "sic", "naics", *funda.RAW]
_STOCK_COLS = ["id", "date", "prc", "ret", "retx", "vol", "shrout", "cfacpr", "cfacshr", "exchcd", "permco", "hsiccd", "cash_div", "rf", "mktrf", "hml", "smb_ff"]
_DAILY_COLS = ["id", "date", "prc", "bidlo", "askhi", "ret", "vol", "shrout", "cfacpr", "exchcd", "rf", "mktrf", "hml", "smb_ff"]
_register("funda_chars", _FUNDA, _FUNDA_COLS, funda.prepare, funda.formulas(_T))
_register("fundq_chars", _FUNDQ, ["id", "date", *fundq.RAW], fundq.prepare, fundq.formulas(_T))
_register("crspm_chars", _STOCK, _STOCK_COLS, crspm.prepare, crspm.formulas(_T), 17)


#: Variants of the replication, and yearly accounts on a monthly grid: a period is twelve rows.
_JKP, _M12 = Terms(jkp=True), Terms(m=12)
_register("funda_chars_jkp", _FUNDA, _FUNDA_COLS, funda.prepare, funda.formulas(_JKP), 40, _JKP, ["debt_gr3", "inv_gr1a", "fnl_gr1a", "netis_at", "eqnetis_at", "oaccruals_at", "lnoa_gr1a", "dsale_dinv", "be_gr1a", "f_score", "kz_index"])
_MONTHLY_ITEMS = f"(select id, date, (row_number() over (partition by id order by date) - 1) % 12 as ph, make_date(cast(year(date) - 16 as int), 12, 31) as datadate, cast(year(date) as int) as fyear, case ind % 8 when 0 then '4011' when 1 then '4512' when 2 then '4812' else cast(2000 + (ind * 173 + id % 4) % 5200 as string) end as sic, '3254' as naics, {_items(funda.RAW)} from (select *, cast(year(date) as int) as p from ({PM}) a) b)"
_register("funda_chars_monthly", _MONTHLY_ITEMS, ["id", "date", "ph", *_FUNDA_COLS[2:]], funda.prepare, funda.formulas(_M12), 40, _M12, ["at_gr1", "sale_gr3", "noa_gr1a", "acc", "capex_abn", "earnings_variability", "ni_ar1", "ni_ivol", "dsale_dinv", "emp_gr1", "f_score", "age", "herf_sale", "rd5_at"])


def _daily(spark, sf_dir):
    return frame(spark, sf_dir, f"select * from {_DAILY} t")


def crspd_chars(spark, sf_dir):
    return rounded(crspd.characteristics(_daily(spark, sf_dir)), 5)


def _crspd_source() -> str:
    cols, source = list(_DAILY_COLS), _DAILY
    for step in crspd.prepare(_T):
        keep = [c for c in cols if c not in step]
        source = f"(select {', '.join([*keep, *(f'{v} as {k}' for k, v in step.items())])} from {source} t)"
        cols = [*keep, *step]
    sums = crspd.monthly_sums(source)
    f = crspd.formulas()
    source = f"({sums})"
    for step in levels(f, [k for k in f if not k.startswith("_")]):
        source = f"(select *, {', '.join(f'{v} as {k}' for k, v in step.items())} from {source} t)"
    return source


def _crspd_oracle() -> str:
    names = [*crspd.DIRECT, *(k for k in crspd.formulas() if not k.startswith("_"))]
    return oracle(f"select id, mon, date, {', '.join(f'round({c}, 5) as {c}' for c in names)} from {_crspd_source()} t")


QUERIES["crspd_chars"] = crspd_chars
ORACLES["crspd_chars"] = _crspd_oracle()


def _prepared(spark, sf_dir):
    return replaced(_daily(spark, sf_dir), crspd.prepare(_T))


def crspd_rmax5(spark, sf_dir):
    return rounded(crspd.five_largest(_prepared(spark, sf_dir)))


QUERIES["crspd_rmax5"] = crspd_rmax5
ORACLES["crspd_rmax5"] = oracle(f"select id, mon, case when n > 5 then round(list_avg(list_sort(list_r, 'desc', 'nulls last')[1:5]), 6) end as rmax5_21d from (select id, cast((year(date) - 1900) * 12 + month(date) as bigint) as mon, count(*) as n, list(ret) filter (where ret is not null) as list_r from {_DAILY} t group by all) u")


def crspd_rmax5_rvol(spark, sf_dir):
    return rounded(crspd.largest_to_volatility(_daily(spark, sf_dir)), 5)


QUERIES["crspd_rmax5_rvol"] = crspd_rmax5_rvol
ORACLES["crspd_rmax5_rvol"] = oracle(f"select id, mon, date, round(case when n > 5 then list_avg(list_sort(list_r, 'desc', 'nulls last')[1:5]) end / nullif(rvol_252d, 0), 5) as rmax5_rvol_21d from {_crspd_source()} s join (select id, cast((year(date) - 1900) * 12 + month(date) as bigint) as mon, count(*) as n, list(ret) filter (where ret is not null) as list_r from {_DAILY} t group by all) u using (id, mon)")

#: The factors of the q model, of the kind that the daily panel has for the others.
_Q_FACTORS = {c: f"{a} * {f}({b} * (year(date) * 366 + dayofyear(date)))" for c, a, f, b in (("smb_hxz", 0.007, "cos", 1.3), ("inv", 0.005, "sin", 2.3), ("roe", 0.004, "cos", 2.9))}


def crspd_residuals(spark, sf_dir):
    return crspd.residual_statistics(_prepared(spark, sf_dir).withColumns({c: F.expr(v) for c, v in _Q_FACTORS.items()}))


QUERIES["crspd_residuals"] = crspd_residuals
QUERIES["crspd_weekly"] = lambda spark, sf_dir: crspd.weekly(_prepared(spark, sf_dir))


def crspd_trend_factor(spark, sf_dir):
    return crspd.trend_factor(_prepared(spark, sf_dir))


QUERIES["crspd_trend_factor"] = crspd_trend_factor


def _stocks(spark, sf_dir):
    return replaced(frame(spark, sf_dir, f"select * from {_STOCK} t"), crspm.prepare(_T))


_W60 = "over (partition by id order by date rows between 59 preceding and current row)"


def crspm_beta_jkp(spark, sf_dir):
    """Beta on excess returns that are winsorised over the whole panel."""
    df = frame(spark, sf_dir, f"select * from {_STOCK} t")
    out = crspm.characteristics(df, ["beta_60m"], _JKP)
    return out.select("id", "date", F.round("exret", 6).alias("exret"), F.round("beta_60m", 5).alias("beta_60m"))


QUERIES["crspm_beta_jkp"] = crspm_beta_jkp
ORACLES["crspm_beta_jkp"] = oracle(f"""with e as (select id, date, ret - rf as x, mktrf as m from {_STOCK} t), q as (select quantile_cont(x, 0.001) as a, quantile_cont(x, 0.999) as b from e),
 n as (select min(x) filter (where x >= a) as lo, max(x) filter (where x <= b) as hi from e, q), w as (select id, date, m, case when x is not null then greatest(least(x, hi), lo) end as x from e, n)
 select id, date, round(x, 6) as exret, case when count(case when m is not null then x end) {_W60} >= 36 then round(regr_slope(x, m) {_W60}, 5) end as beta_60m from w""")


QUERIES["crspm_residual_momentum"] = lambda spark, sf_dir: crspm.residual_momentum(_stocks(spark, sf_dir))


def funda_from_quarters(spark, sf_dir):
    """Annual accounts renewed each quarter, and their growth over four quarters."""
    df = fundq.annual_from_quarters(frame(spark, sf_dir, f"select * from {_QUARTERS.format(_PQ)} t"))
    p = Panel(df.select("id", "date", "fqtr", "sale", "cogs", "at", "prcc_f"))
    out = p.with_columns(sale_gr1=p.pct_change("sale", 4), gp_at=(F.col("sale") - F.col("cogs")) / F.nullif(F.col("at"), F.lit(0.0)))
    return rounded(out.df)


_FOUR = "over (partition by id order by date rows between 3 preceding and current row)"
_MONTHS = "(year({0}) * 12 + month({0}))"
QUERIES["funda_from_quarters"] = funda_from_quarters
ORACLES["funda_from_quarters"] = oracle(f"""with q as (select *, lag(date, 3) over (partition by id order by date) as d3, fyearq * 4 + fqtr - lag(fyearq * 4 + fqtr, 3) over (partition by id order by date) as l3, sum(saleq) {_FOUR} as s4, count(cogsq) {_FOUR} as nc, sum(cogsq) {_FOUR} as c4 from {_QUARTERS.format(_PQ)} t),
 r as (select *, coalesce({_MONTHS.format('date')} - {_MONTHS.format('d3')} = 9, false) as run from q), c as (select *, run and l3 <> 3 as moved from r),
 a as (select id, date, fqtr, case when fqtr = 4 and not moved then saley when run then s4 end as sale, coalesce(case when fqtr = 4 and not moved then cogsy end, case when run and nc = 4 then c4 end) as cogs, atq as at_, prccq from c)
 select id, date, fqtr, round(sale, 6) as sale, round(cogs, 6) as cogs, round(at_, 6) as "at", round(prccq, 6) as prcc_f, round(case when lag(sale, 4) over w > 1e-7 then sale / lag(sale, 4) over w - 1 end, 6) as sale_gr1, round((sale - cogs) / nullif(at_, 0), 6) as gp_at from a window w as (partition by id order by date)""")


def merge_chars(spark, sf_dir):
    """Monthly stocks with the latest accounts of their firm's year and the mispricing and quality ranks."""
    t = _T
    fa = replaced(frame(spark, sf_dir, f"select * from {_FUNDA} t"), funda.prepare(t))
    exprs = {**funda.formulas(t), **merged.quality_helpers(t)}
    need = ["o_score", "gp_at", "oaccruals_at", "noa_at", "at_gr1", "ppeinv_gr1a", "ni_be", "ocf_at", "z_score", "ni_at", "gp_sale", "debt_at", "gpoa_ch5", "roe_ch5", "roa_ch5", "cfoa_ch5", "gmar_ch5", "roe_std"]
    fa = create(fa, exprs, need).select("id", F.year("date").alias("_y"), *need)
    fq = frame(spark, sf_dir, f"select * from {_FUNDQ} t")
    fq = fundq.characteristics(fq, ["niq_at"]).select("id", "date", "niq_at")
    cm = crspm.characteristics(frame(spark, sf_dir, f"select * from {_STOCK} t"), ["ret_12_1", "chcsho_12m", "eqnpo_12m", "beta_60m"])
    df = merged.assemble(cm.withColumn("_y", F.year("date") - 1), None, None, fq, "id").join(fa, ["id", "_y"], "left")
    df = df.withColumns({"betabab_1260d": F.col("beta_60m"), "roeq_std": F.lit(None).cast("double")})
    out = merged.quality(merged.mispricing(merged.age(df)))
    return rounded(out.select("id", "date", "age", "mispricing_perf", "mispricing_mgmt", "qmj_growth", "qmj_prof", "qmj_safety", "qmj"))


QUERIES["merge_chars"] = merge_chars


def _sorted_panel(spark, sf_dir):
    return frame(spark, sf_dir, f"select *, lead(ret) over (partition by id order by date) as fret, net / sale as x1, cnt / qty as x2 from ({PM}) p")


def factor_returns(spark, sf_dir):
    return rounded(factors.factor_portfolios(_sorted_panel(spark, sf_dir), {"hml": ("x1", True), "cma": ("x2", False)}, "fret", "me"))


def _factor_sql() -> str:
    q = "case when exchcd = 1 then {} end"
    cut = lambda c, p: f"quantile_cont({q.format(c)}, {p}) over (partition by date)"
    mean = lambda cond: f"sum(case when {cond} then fret * me end) / nullif(sum(case when {cond} and fret is not null then me end), 0)"
    cols = [f"{mean('true')} as mkt"]
    for k in ("x1", "x2"):
        for s, c in (("s", "me <= s0"), ("b", "me > s0")):
            for i, d in enumerate((f"{k} <= {k}l", f"{k} > {k}l and {k} <= {k}h", f"{k} > {k}h")):
                cols.append(f"{mean(f'{c} and {d}')} as {k}{s}{i}")
    smb = lambda k: f"({k}s0 + {k}s1 + {k}s2 - {k}b0 - {k}b1 - {k}b2) / 3"
    return oracle(f"with p as (select *, lead(ret) over (partition by id order by date) as fret, net / sale as x1, cnt / qty as x2 from ({PM}) p), c as (select *, {cut('me', 0.5)} as s0, {cut('x1', 0.3)} as x1l, {cut('x1', 0.7)} as x1h, {cut('x2', 0.3)} as x2l, {cut('x2', 0.7)} as x2h from p), g as (select date, {', '.join(cols)} from c group by date) select date, round(mkt, 6) as mkt, round((x1s2 + x1b2 - x1s0 - x1b0) / 2, 6) as hml, round({smb('x1')}, 6) as smb_hml, round((x2s0 + x2b0 - x2s2 - x2b2) / 2, 6) as cma, round({smb('x2')}, 6) as smb_cma, round(({smb('x1')} + {smb('x2')}) / 2, 6) as smb from g")


QUERIES["factor_portfolios"] = factor_returns
ORACLES["factor_portfolios"] = _factor_sql()
QUERIES["characteristic_portfolios"] = lambda spark, sf_dir: rounded(factors.characteristic_portfolios(_sorted_panel(spark, sf_dir), ["x1", "x2", "prc"], "fret"))
QUERIES["june_sorts"] = lambda spark, sf_dir: rounded(factors.june_sorts(frame(spark, sf_dir, PM), frame(spark, sf_dir, f"select id, date as datadate, net / 10 as be from ({PA}) a")))
