"""Queries of trade ledgers: cost tables by id and by date and id, a risk-free rate, kinds of return, spans of losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import portfolio as P

from .panels import PM, frame
from .queries import _PF, _POS, _position, query, rounded

#: Rates of two thirds of the ids.
_BY_ID = f"select id, 0.001 * (1 + id % 5) as cost from (select distinct id from ({PM}) a) b where id % 3 <> 0"
#: Each quarter's end the parts of most ids' costs; they hold until the id's next row.
_PARTS = f"select id, date, 0.05 as buy_fixed, 0.0005 * (1 + id % 3) as buy_linear, 0.00002 as buy_quad, 0.001 * (1 + month(date)) as sell_linear, case when id % 2 = 0 then 0.00001 end as sell_quad from ({PM}) a where month(date) % 3 = 0 and id % 7 <> 0"
_RF = "0.0004 * month(date)"


@query(f", {_PF}, cs as (select pf, date, sum(abs(a - b) * coalesce(cost, 0)) as c from tr left join ({_BY_ID}) k using (id) group by pf, date) select pf, date, round(case when fst then 0 else c / value0 end, 8) as cost, round(r - case when fst then 0 else c / value0 end, 6) as net_ret from v0 join cs using (pf, date)")
def portfolio_costs_by_id(spark, sf_dir):
    costs = P.Costs.of_table(frame(spark, sf_dir, _BY_ID), ("id",))
    out = P.portfolio_returns(_position(spark, sf_dir), cost=costs)
    return out.select("pf", "date", F.round("cost", 8).alias("cost"), F.round("net_ret", 6).alias("net_ret"))


_BOTH = f"""{_POS}, two as (select 9 as pf, date, id, ret, case when pf = 0 then 0.8 * wgt else -0.3 * wgt end as wgt, {_RF} as rf from pos where pf in (0, 4)),
 b as (select pf, date, sum(wgt * ret) as r, sum(wgt * (ret - rf)) as e, sum(case when wgt > 0 then wgt else 0 end) as lw, max(rf) as rf, cast(count_if(wgt > 0) as bigint) as n_long, cast(count_if(wgt < 0) as bigint) as n_short from two group by pf, date),
 g as (select *, r + (1 - lw) * rf as gross, e + (1 - lw) * rf as excess from b),
 v as (select *, 1000 * exp(sum(ln(1 + gross)) over (partition by pf order by date)) as value, lead(date) over (partition by pf order by date) as nxt, row_number() over (partition by pf order by date) = 1 as fst from g),
 v0 as (select *, coalesce(lag(value) over (partition by pf order by date), 1000) as value0 from v),
 held as (select two.*, value0, nxt from two join v0 using (pf, date)),
 tr as (select pf, date, id, sum(a) as a, sum(b) as b from (select pf, date, id, wgt * value0 as a, 0 as b from held union all select pf, nxt, id, 0, wgt * value0 * (1 + ret) from held where nxt is not null) group by pf, date, id),
 pr as (select tr.*, case when a > b then coalesce(buy_fixed, 0) + coalesce(buy_linear, 0) * (a - b) + coalesce(buy_quad, 0) * (a - b) * (a - b) when a < b then coalesce(sell_linear, 0) * (b - a) + coalesce(sell_quad, 0) * (b - a) * (b - a) else 0 end as c
   from tr asof left join ({_PARTS}) k on tr.id = k.id and tr.date >= k.date),
 cs as (select pf, date, sum(abs(a - b)) as amount, sum(c) as c from pr group by pf, date),
 net as (select pf, date, gross as gross_ret, excess, value, n_long, n_short, case when fst then 0 else amount / value0 end as turnover, case when fst then 0 else c / value0 end as cost from v0 join cs using (pf, date)) """


def _both_sides(spark, sf_dir):
    held = P.long_short(_position(spark, sf_dir), 0, 4, 9, (0.8, -0.3)).withColumn("rf", F.expr(_RF))
    return P.portfolio_returns(held, rf="rf", cost=P.Costs.of_table(frame(spark, sf_dir, _PARTS), ("date", "id"), carried=True), start=1000.0)


@query(f", {_BOTH} select pf, date, round(gross_ret, 6) as gross_ret, round(gross_ret - cost, 6) as net_ret, round(excess, 6) as excess, round(excess - cost, 6) as net_excess, round(value, 4) as value, n_long, n_short, round(turnover, 6) as turnover, round(cost, 8) as cost from net")
def portfolio_cost_tables(spark, sf_dir):
    out = _both_sides(spark, sf_dir)
    return out.select("pf", "date", *(F.round(c, 6).alias(c) for c in ("gross_ret", "net_ret", "excess", "net_excess", "turnover")), F.round("value", 4).alias("value"), "n_long", "n_short", F.round("cost", 8).alias("cost"))


def _spans(ret: str, excess: str) -> str:
    """SQL of one row of evaluation, with the spans of the worst losses."""
    return f"""x as (select pf, date, {ret} as r, {excess} as e, row_number() over w as t, first_value(date) over w as d0 from net window w as (partition by pf order by date)),
 cu as (select *, sum(ln(1 + r)) over (partition by pf order by date) as cum from x), pk as (select *, greatest(0, max(cum) over (partition by pf order by date)) as peak from cu),
 mk as (select *, max(case when cum >= peak then t end) over w as tt, max(case when r > 0 then t end) over w as tu from pk window w as (partition by pf order by date)),
 sp as (select mk.*, 1 - exp(mk.cum - mk.peak) as dd, mk.t - coalesce(tt, 0) as dur, coalesce(a.date, mk.d0) as beg, greatest(0, 1 - exp(mk.cum - coalesce(b.cum, 0))) as sd, mk.t - coalesce(tu, 0) as sdur, coalesce(b.date, mk.d0) as sbeg
   from mk left join pk a on a.pf = mk.pf and a.t = mk.tt left join pk b on b.pf = mk.pf and b.t = mk.tu),
 rk as (select *, row_number() over (partition by pf order by dd desc, date) as i, row_number() over (partition by pf order by sd desc, date) as j from sp)
 select pf, count(*) as periods, round(avg(e) * 12, 6) as mean, round(stddev_pop(e) * sqrt(12), 6) as std, round(avg(e) / stddev_pop(e) * sqrt(12), 6) as sharpe, round(max_by(cum, date), 6) as cum_ret,
 round(max(dd), 6) as mdd, max(case when i = 1 then beg end) as mdd_start, max(case when i = 1 then date end) as mdd_end, cast(max(case when i = 1 then dur end) as bigint) as mdd_duration,
 round(max(sd), 6) as msd, max(case when j = 1 then sbeg end) as msd_start, max(case when j = 1 then date end) as msd_end, cast(max(case when j = 1 then sdur end) as bigint) as msd_duration from rk group by pf"""


def _told(e):
    return rounded(e.select("pf", "periods", "mean", "std", "sharpe", "cum_ret", "mdd", "mdd_start", "mdd_end", F.col("mdd_duration").cast("long").alias("mdd_duration"), "msd", "msd_start", "msd_end", F.col("msd_duration").cast("long").alias("msd_duration")))


@query(f", {_BOTH}, {_spans('gross_ret - cost', 'excess - cost')}")
def evaluate_net(spark, sf_dir):
    return _told(P.evaluate(_both_sides(spark, sf_dir), kind="net"))


@query(f", {_BOTH}, {_spans('excess', 'excess')}")
def evaluate_gross_excess(spark, sf_dir):
    return _told(P.evaluate(_both_sides(spark, sf_dir), kind="grossexret"))


@query(f", net as (select id as pf, date, ret from pm where ret is not null and ret > -1), {_spans('ret', 'ret')}")
def evaluate_known_returns(spark, sf_dir):
    return _told(P.evaluate(P.from_returns(frame(spark, sf_dir, PM).where("ret > -1"), "ret", pf="id"), kind="gross"))
