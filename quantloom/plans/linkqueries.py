"""Registered queries of user functions by group and of the panels' join steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quantloom.operators import groups as G
from quantloom.operators import links as L
from quantloom.operators.panel import DAILY, Panel
from quantloom.plans.panels import PD, frame, monthly
from quantloom.plans.queries import query, rounded


@query(", k as (select id, date, ret, sum(case when ret > 0 then 0 else 1 end) over (partition by id order by date) as k from pm) select id, date, cast(sum(case when ret > 0 then 1 else 0 end) over (partition by id, k order by date) as bigint) as streak from k")
def apply_to_ids(spark, sf_dir):
    """Rows in succession with a positive return, up to each row."""

    def streak(x: pd.DataFrame) -> pd.DataFrame:
        up = x["ret"] > 0
        return x[["id", "date"]].assign(streak=up.astype("int64").groupby((~up).cumsum()).cumsum())

    p = monthly(spark, sf_dir)
    return G.apply_to_ids(p.of(p.df.select("id", "date", "ret")), streak, "id long, date date, streak long")


@query(", m as (select date, median(sale) as mid from pm where exchcd = 1 group by date) select pm.date, cast(count(*) as bigint) as n, cast(count(*) filter (sale > mid) as bigint) as above from pm left join m using (date) group by pm.date")
def apply_to_dates(spark, sf_dir):
    """Rows of each date, and those above the median of a second table."""

    def above(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"date": x["date"].iloc[:1], "n": len(x), "above": int((x["sale"] > y["sale"].median()).sum())})

    p = monthly(spark, sf_dir)
    df = p.df.select("id", "date", "sale", "exchcd")
    return G.apply_to_dates(p.of(df), above, "date date, n long, above long", df.where("exchcd = 1"))


@query(", f as (select id, date_trunc('month', date) as mon, first(value order by date) as a, last(value order by date) as b, max(value) - min(value) as spread from pd group by 1, 2) select id, cast(mon as date) as mon, round(b - a, 6) as moved, round(spread, 6) as spread from f")
def apply_to_id_months(spark, sf_dir):
    """Of each id and month the spread of daily values, and last less first."""

    def month(x: pd.DataFrame) -> pd.DataFrame:
        v = x["value"]
        return pd.DataFrame({"id": x["id"].iloc[:1], "mon": [x["date"].iloc[0].replace(day=1)], "moved": v.iloc[-1] - v.iloc[0], "spread": v.max() - v.min()})

    p = Panel(frame(spark, sf_dir, PD), freq=DAILY)
    return rounded(G.apply_to_id_months(p, month, "id long, mon date, moved double, spread double"))


_FACTORS = "select date_trunc('month', date) as date, round(avg(ret), 6) as mkt, round(avg(case when exchcd = 1 then ret end), 6) as small, cast(0.002 as double) as rf from {pm} group by date_trunc('month', date)"


@query(f", f as ({_FACTORS.format(pm='pm')}) select pm.id, pm.date, pm.ret, f.mkt as mktrf, f.small as smb_ff from pm left join f on pm.date = last_day(f.date)")
def merge_with_factors(spark, sf_dir):
    df = monthly(spark, sf_dir).df
    factors = spark.sql(_FACTORS, pm=df).withColumn("date", F.to_date("date"))
    return L.merge_with_factors(df.select("id", "date", "ret"), factors, {"mktrf": "mkt", "smb_ff": "small"}).select("id", "date", "ret", "mktrf", "smb_ff")


_RATES = "select distinct date_trunc('month', date) as caldt, month(date) / cast(1000 as double) as t30ret from {pm}"


@query(f", f as ({_RATES.format(pm='pm')}) select last_day(caldt) as date, t30ret as rf from f where last_day(caldt) between date '1996-01-31' and date '1999-06-30'")
def risk_free_rate(spark, sf_dir):
    rates = spark.sql(_RATES, pm=monthly(spark, sf_dir).df).withColumn("caldt", F.to_date("caldt"))
    return L.risk_free_rate(rates, "caldt", "t30ret", "1996-01-31", "1999-06-30", month_end=True)


_ACCOUNTS = "select id as gvkey, date, make_date(cast(year(date) - 1 as int), 12, 31) as datadate, sale from {pm}"
_STOCKS = "select id as gvkey, date, me as me_company, cnt % 7 <> 0 as primary from {pm}"
_ME = "a as (select id as gvkey, date, make_date(cast(year(date) - 1 as int), 12, 31) as datadate, sale from pm), s as (select id as gvkey, date, me from pm where cnt % 7 <> 0 and me > 0)"


def _with_equity(spark, sf_dir, method: str):
    df = monthly(spark, sf_dir).df
    out = L.add_market_equity(spark.sql(_ACCOUNTS, pm=df), spark.sql(_STOCKS, pm=df), method)
    return out.select("gvkey", "date", "datadate", "sale", "me", "me_fiscal")


@query(f", {_ME} select a.gvkey, a.date, a.datadate, a.sale, s.me, t.me as me_fiscal from a left join s on a.gvkey = s.gvkey and a.date = s.date left join s t on a.gvkey = t.gvkey and a.datadate = t.date")
def crsp_me_latest(spark, sf_dir):
    return _with_equity(spark, sf_dir, "latest")


@query(f", {_ME} select a.gvkey, a.date, a.datadate, a.sale, t.me, t.me as me_fiscal from a left join s t on a.gvkey = t.gvkey and year(a.datadate) = year(t.date) and month(t.date) = 12")
def crsp_me_year_end(spark, sf_dir):
    return _with_equity(spark, sf_dir, "year_end")


@query("select id, date, cast(9 + cnt % 5 as double) as shrcd, round(sale / qty, 6) as unit from pm where 9 + cnt % 5 >= 10 and 9 + cnt % 5 <= 12")
def ordinary_shares(spark, sf_dir):
    """Ordinary shares, with the made column and without the raw ones."""
    df = monthly(spark, sf_dir).df.withColumns({"shrcd": (9 + F.col("cnt") % 5).cast("double"), "unit": F.col("sale") / F.col("qty")})
    return rounded(L.without_raw(L.ordinary_shares(df), ["id", "date"], ["unit"], ("shrcd",)))
