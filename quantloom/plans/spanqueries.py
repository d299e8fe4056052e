"""Queries of identifiers' histories: a link table by cusip, stocks with their firms and primary stocks."""

from __future__ import annotations

from quantloom.operators import spans as S

from .panels import PM, frame
from .queries import query

_NUMBER = "lpad(cast(id * 10 + {} as string), 8, '0')"
#: Stocks whose cusip changes once, or twice a year, and is unknown at times.
_STOCKS = f"select id, date, case when (id + month(date)) % 11 <> 0 then {_NUMBER.format('case when id % 3 = 0 and year(date) >= 1996 then 1 when id % 3 = 1 and month(date) > 6 then 2 else 0 end')} || '7' end as cusip, prc, cnt as vol, ind as permco from ({PM}) a"
_IDS = f"select distinct id from ({PM}) a"
_NAMED = " union all ".join(f"select id, {_NUMBER.format(k)} || '3' as cusip, 'G' || cast(cast(floor(id / 3) as int) as string) as gvkey from ({_IDS}) i" for k in range(3))
#: Each holds for two times, which overlap, adjoin or leave a gap, and end or not.
_SECURITIES = f"select id, cusip, gvkey, date '1993-01-01' as since, make_date(1995, cast(1 + id % 12 as int), 15) as until from ({_NAMED}) a union all select id, cusip, gvkey, make_date(1995, cast(1 + id % 12 as int), cast(case when id % 5 = 0 then 16 when id % 5 = 1 then 10 else 18 end as int)), case when id % 4 <> 0 then make_date(1997, 6, cast(1 + id % 30 as int)) end from ({_NAMED}) b"
_ACCOUNTS = f"select {_NUMBER.format(0)} || '9' as cusip from ({_IDS}) i where id % 2 = 0"


@query(f"""
, st as ({_STOCKS}), se as ({_SECURITIES}), h0 as (select id, left(cusip, 8) as cusip, date from st where cusip is not null),
h1 as (select *, cast(lag(cusip) over (partition by id order by date) is distinct from cusip as int) as ch from h0), h2 as (select *, sum(ch) over (partition by id order by date) as run from h1),
h as (select id, cusip, min(date) as s, max(date) as e from h2 group by id, cusip, run),
m0 as (select left(cusip, 8) as cusip, gvkey, since as s, coalesce(until, date '9999-12-31') as e from se), m1 as (select *, max(e) over (partition by cusip, gvkey order by s, e rows between unbounded preceding and 1 preceding) as r from m0),
m2 as (select *, sum(case when r is null or date_diff('day', r, s) > 1 then 1 else 0 end) over (partition by cusip, gvkey order by s, e rows unbounded preceding) as isl from m1), m as (select cusip, gvkey, min(s) as s, max(e) as e from m2 group by cusip, gvkey, isl)
select h.cusip, gvkey, id, greatest(h.s, m.s) as linkdt, least(h.e, m.e) as linkenddt, h.cusip in (select left(cusip, 8) from ({_ACCOUNTS})) as linkprim from h join m using (cusip) where greatest(h.s, m.s) <= least(h.e, m.e)""")
def cusip_linktable(spark, sf_dir):
    stocks, securities, accounts = (frame(spark, sf_dir, x) for x in (_STOCKS, _SECURITIES, _ACCOUNTS))
    return S.cusip_linktable(stocks, securities, accounts, "id", by_history=True, span=("since", "until"))


@query(f"""
, st as ({_STOCKS}), f as (select id, min_by(left(cusip, 8), date) filter (where cusip is not null) as cusip, min(date) as s, max(date) as e from st group by id),
l as (select f.id, gvkey, s, e, cusip in (select left(cusip, 8) from ({_ACCOUNTS})) as prim from f join (select distinct left(cusip, 8) as cusip, gvkey from ({_NAMED})) using (cusip)),
x as (select st.id, date, gvkey as firm, permco as grp, coalesce(prim, false) as linked, prc * vol as dv from st left join l on st.id = l.id and date between s and e),
a as (select *, linked or (firm is not null and count(*) over (partition by date, firm) = 1) as p1 from x), b as (select *, p1 or (firm is not null and sum(cast(p1 as int)) over (partition by date, firm) = 0 and dv = max(dv) over (partition by date, firm)) as p2 from a)
select id, date, firm as gvkey, p2 or (firm is null and sum(cast(p2 as int)) over (partition by date, grp) = 0 and dv = max(dv) over (partition by date, grp)) as "primary" from b""")
def linked_stocks(spark, sf_dir):
    stocks, securities, accounts = (frame(spark, sf_dir, x) for x in (_STOCKS, _NAMED, _ACCOUNTS))
    return S.linked_stocks(stocks, S.cusip_linktable(stocks, securities, accounts, "id"), "id").select("id", "date", "gvkey", "primary")
