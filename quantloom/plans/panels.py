"""Panels made from the tables at hand, as SQL that Spark and DuckDB both read: monthly and yearly supplier panels, daily user panel.

Amounts are rounded to the decimals that they have, so that sums in another order don't give other values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.operators.panel import ANNUAL, MONTHLY, Panel


def _supplier(date: str) -> str:
    return f"""select l_suppkey as id, {date} as date, max(s_nationkey) as ind, cast(l_suppkey % 3 + 1 as int) as exchcd,
 round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice), 2) as sale, round(sum(l_extendedprice * (1 - l_discount)), 4) as net,
 round(sum(l_extendedprice * l_tax), 4) as tax, count(*) as cnt
 from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey group by l_suppkey, {date}"""


#: Monthly panel: id, date, ind, exchcd, qty, sale, net, tax, cnt, prc, me, ret.
PM = f"""select *, prc / lag(prc) over (partition by id order by date) - 1 as ret
from (select *, sale / qty as prc, sale as me from ({_supplier("last_day(cast(l_shipdate as date))")}) a) b"""
#: Yearly panel, dated at year ends.
PA = f"""select *, sale / qty as prc from ({_supplier("make_date(cast(year(l_shipdate) as int), 12, 31)")}) a"""
#: Daily panel of users: id, date, value, n.
PD = "select user_id as id, cast(ts as date) as date, round(sum(value), 4) as value, count(*) as n from {events} group by user_id, cast(ts as date)"

TABLES = ("lineitem", "supplier", "events", "orders", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def monthly(spark: SparkSession, sf_dir: str) -> Panel:
    return Panel(frame(spark, sf_dir, PM), freq=MONTHLY)


def yearly(spark: SparkSession, sf_dir: str) -> Panel:
    return Panel(frame(spark, sf_dir, PA), freq=ANNUAL, base_freq=ANNUAL)
