"""Queries of all factor models in one plan, monthly and daily, and of characteristic portfolios by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import factors
from .panels import PA, PM, frame
from .queries import query, rounded

_CHARS = {"be_me": "net / sale", "ope_be": "cnt / qty", "at_gr1": "tax / net", "niq_be": "net / qty", "mispricing_mgmt": "case when (id + month(date)) % 9 <> 0 then cast((id * 37 + month(date) * 11) % 101 as double) + qty / 64 end", "mispricing_perf": "qty / cnt"}
_NAMES = ", ".join(_CHARS)
_MONTHLY = f"select id, date, ret - 0.0004 * month(date) as exret, me, exchcd, id % 5 <> 0 as \"primary\", 0.0004 * month(date) as rf, {', '.join(f'{v} as {k}' for k, v in _CHARS.items())} from ({PM}) p"
#: A stock of the daily panel is a supplier of it; its days are those with an item shipped.
_DAILY = """select id, date, p / lag(p) over (partition by id order by date) - 1 as exret, p * 1000 as me, cast(id % 3 + 1 as int) as exchcd, id % 5 <> 0 as "primary", 0.00002 * month(date) as rf
 from (select l_suppkey as id, cast(l_shipdate as date) as date, round(sum(l_extendedprice), 2) / sum(l_quantity) as p from {lineitem} group by l_suppkey, cast(l_shipdate as date)) a"""


def _quoted(sql: str) -> str:
    return sql.replace('"primary"', "`primary`")


def _models_sql(held: str) -> str:
    """All models of rows for sorts, each factor's portfolios by themselves."""
    nyse = "case when exchcd = 1 then {} end"
    cuts = [f"quantile_cont({nyse.format('me')}, 0.5) over (partition by date) as s0"]
    cuts += [f"quantile_cont({nyse.format(c)}, {q}) over (partition by date) as {c}_{k}" for c in _CHARS for k, q in (("l", 0.3), ("h", 0.7))]
    mean = lambda cond: f"sum(exret * me) filter (where {cond}) / nullif(sum(me) filter (where {cond}), 0)"
    cells = [f"{mean(f'{s} and {d}')} as {c}_{k}{i}" for c in _CHARS for k, s in (("s", "me <= s0"), ("b", "me > s0")) for i, d in enumerate((f"{c} <= {c}_l", f"{c} > {c}_l and {c} <= {c}_h", f"{c} > {c}_h"))]
    hml = lambda c: f"({c}_s2 + {c}_b2 - {c}_s0 - {c}_b0) / 2"
    smb = lambda c: f"({c}_s0 + {c}_s1 + {c}_s2 - {c}_b0 - {c}_b1 - {c}_b2) / 3"
    of = {"smb_ff": smb("be_me"), "hml": hml("be_me"), "smb_ff5": f"({smb('be_me')} + {smb('ope_be')} + {smb('at_gr1')}) / 3", "rmw": hml("ope_be"), "cma": f"-{hml('at_gr1')}", "smb_hxz": f"({smb('at_gr1')} + {smb('niq_be')}) / 2", "inv": f"-{hml('at_gr1')}", "roe": hml("niq_be"), "smb_sy": f"({smb('mispricing_mgmt')} + {smb('mispricing_perf')}) / 2", "mgmt": hml("mispricing_mgmt"), "perf": hml("mispricing_perf")}
    return f"{held}, c as (select *, {', '.join(cuts)} from h), g as (select date, sum(exret * me) / sum(me) as mktrf, max(rf) as rf, {', '.join(cells)} from c group by date) select date, round(mktrf, 6) as mktrf, round(rf, 6) as rf, {', '.join(f'round({v}, 6) as {k}' for k, v in of.items())} from g"


_LAGGED = "lag({0}) over (partition by id order by date) as {0}"
_HELD = f", m as ({_MONTHLY}), l as (select id, date, exret, {', '.join(_LAGGED.format(c) for c in ('me', 'exchcd', chr(34) + 'primary' + chr(34), 'rf', *_CHARS))} from m), h as (select * from l where exret is not null and me is not null and \"primary\")"
_DAY_HELD = f", m as ({_MONTHLY}), d as ({_DAILY}), l as (select id, date, exret, {', '.join(_LAGGED.format(c) for c in ('me', 'exchcd', chr(34) + 'primary' + chr(34), 'rf'))}, lag(last_day(date)) over (partition by id order by date) as mon from d), h as (select l.*, {', '.join(f'm.{c}' for c in _CHARS)} from l left join m on l.id = m.id and l.mon = m.date where l.exret is not null and l.me is not null and l.\"primary\")"


def _monthly(spark, sf_dir):
    return frame(spark, sf_dir, _quoted(_MONTHLY))


@query(_models_sql(_HELD))
def factor_models(spark, sf_dir):
    return rounded(factors.factor_models(factors.held_next(_monthly(spark, sf_dir))))


@query(_models_sql(_DAY_HELD))
def factor_models_daily(spark, sf_dir):
    daily = frame(spark, sf_dir, _quoted(_DAILY))
    return rounded(factors.factor_models(factors.daily_held_next(daily, _monthly(spark, sf_dir), list(_CHARS))))


_TWO = ("be_me", "mispricing_mgmt")


@query(f"""{_HELD}, z as (select *, quantile_cont(case when exchcd = 1 then me end, 0.2) over (partition by date) as s0 from h), q as (select quantile_cont(case when exchcd = 1 then me end, 0.8) as cap from h),
 k as (select max(me) as most from h, q where exchcd = 1 and me <= cap), x as ({' union all '.join(f"select date, '{c}' as ch, {c} as x, exret as r, me, least(me, most) as mc, me > s0 as big from z, k where {c} is not null" for c in _TWO)}),
 c as (select *, quantile_cont(case when big then x end, 1 / 3) over (partition by date, ch) as a, quantile_cont(case when big then x end, 2 / 3) over (partition by date, ch) as b from x),
 g as (select date, ch, case when x > b then 'h' when x > a then 'm' else 'l' end as g, avg(r) as ew, sum(r * me) / sum(me) as vw, sum(r * mc) / sum(mc) as vc, avg(x) as s, count(*) as n from c where a is not null group by all),
 u as (select * from g union all select h.date, h.ch, 'hml', h.ew - l.ew, h.vw - l.vw, h.vc - l.vc, h.s - l.s, h.n - l.n from g h join g l on h.date = l.date and h.ch = l.ch and h.g = 'h' and l.g = 'l')
 select date, ch as "char", g as "group", round(ew, 6) as ret_ew, round(vw, 6) as ret_vw, round(vc, 6) as ret_vw_cap, round(s, 6) as signal, n as n_firms from u""")
def char_portfolios(spark, sf_dir):
    return rounded(factors.char_portfolios(factors.held_next(_monthly(spark, sf_dir)), list(_TWO)).withColumn("n_firms", F.col("n_firms").cast("long")))


_JUNE = f"select id, date, ret, case when (id + month(date)) % 13 <> 0 then ret - 0.001 end as retx, me, exchcd, id % 5 <> 0 as \"primary\" from ({PM}) p"
#: Accounts of a second fiscal year end in some years, and negative book values.
_BOOKS = "select id, date as datadate, case when (id + year(date)) % 17 = 0 then -1.0 else net / (1 + id % 4) end as be from ({0}) a union all select id, make_date(cast(year(date) as int), 6, 30), net * 3 from ({0}) b where id % 6 = 0"


def _june_sql(held: bool) -> str:
    weight = "case when month(hold_date) = 1 then lme else max(case when month(hold_date) = 1 then lme end) over (partition by id, year(hold_date)) * lcum end" if held else "lme"
    first = "case when row_number() over (partition by id order by date) = 1 then me / (1 + retx) else lag(me) over (partition by id order by date) end" if held else "lag(me) over (partition by id order by date)"
    rows, counts = ("where w > 0", "exchcd = 1") if held else ('where "primary" and me > 0', "exchcd = 1 and age > 1")
    base = "m" if held else 'm where "primary" and me > 0'
    cells = [f"{s}{v}" for s in "sb" for v in "lmh"]
    mean = lambda c: f"sum(ret * w) filter (where cell = '{c}') / nullif(sum(w) filter (where cell = '{c}' and ret is not null), 0) as {c}"
    return f""", a as ({_JUNE}), b as (select *, date - interval 6 month as hold_date, {first} as lme from a),
 g as (select *, coalesce(sum(ln(1 + retx)) over (partition by id, year(hold_date) order by date), 0) as cum from b), l as (select *, exp(lag(cum) over (partition by id order by date)) as lcum from g),
 m as (select *, cast(year(hold_date) as int) as hold, {weight} as w from l), k as (select id, cast(year(datadate) as int) as y, max_by(be, datadate) as be from ({_BOOKS.format(PA)}) x group by 1, 2),
 kk as (select *, row_number() over (partition by id order by y) - 1 as age from k), ju as (select id, cast(year(date) as int) - 1 as y, me as size, exchcd from (select * from {base}) where month(date) = 6 and me > 0),
 de as (select id, cast(year(date) as int) as y, me as dec from (select * from {base}) where month(date) = 12 and me > 0), s as (select ju.*, age, be / dec as bm from ju join kk using (id, y) join de using (id, y) where age >= 1 and be > 0),
 c as (select *, quantile_cont(case when {counts} then size end, 0.5) over (partition by y) as s0, quantile_cont(case when {counts} then bm end, 0.3) over (partition by y) as b0, quantile_cont(case when {counts} then bm end, 0.7) over (partition by y) as b1 from s),
 t as (select id, y + 1 as hold, case when size > s0 then 'b' else 's' end || case when bm > b1 then 'h' when bm > b0 then 'm' else 'l' end as cell from c where s0 is not null),
 j as (select * from (select * from m {rows}) m join t using (id, hold)), f as (select date, {', '.join(map(mean, cells))}, {', '.join(f"count(ret) filter (where cell = '{c}') as n_{c}" for c in cells)} from j group by date)
 select date, {', '.join(f'round({c}, 6) as {c}' for c in cells)}, round((sl + sm + sh - bl - bm - bh) / 3, 6) as smb, round((sh + bh - sl - bl) / 2, 6) as hml, {', '.join(f'n_{c}' for c in cells)}, {' + '.join(f'n_{c}' for c in cells)} as n_smb, n_bh + n_sh + n_bl + n_sl as n_hml from f"""


def _june(spark, sf_dir, held: bool):
    return rounded(factors.june_factors(frame(spark, sf_dir, _quoted(_JUNE)), frame(spark, sf_dir, _BOOKS.format(PA)), held))


@query(_june_sql(False))
def june_factors(spark, sf_dir):
    return _june(spark, sf_dir, False)


@query(_june_sql(True))
def june_factors_held(spark, sf_dir):
    return _june(spark, sf_dir, True)
