"""The registered queries over the derived panels, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import is_zero, sample_skewness, sum_present
from quantloom.operators import analytics as A
from quantloom.operators import cross as X
from quantloom.operators import joins as J
from quantloom.operators import portfolio as P
from quantloom.operators import rolling
from quantloom.operators.panel import MONTHLY, Panel, add_months
from quantloom.plans.panels import PA, PD, PM, frame, monthly, oracle, table, yearly

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_WITH = f"with pm as ({PM}), pa as ({PA}), pd as ({PD}) "
_ID = "over (partition by id order by date)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = oracle(_WITH + sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _column(name: str, make, sql: str, panel=monthly, src: str = "pm"):
    """A query of id, date and one made column x."""

    def run(spark, sf_dir):
        p = panel(spark, sf_dir)
        out = make(p)
        p, c = out if isinstance(out, tuple) else (p, out)
        return rounded(p.df.withColumn("x", c).select("id", "date", "x"))

    query(f"select id, date, {sql} as x from {src}", name)(run)


def _r(x: str) -> str:
    return f"round({x}, 6)"


_column("panel_shift", lambda p: p.shift("sale", 2), f"{_r(f'lag(sale, 2) {_ID}')}")
_column("panel_shift_lead", lambda p: p.shift("sale", -1), f"{_r(f'lead(sale) {_ID}')}")
_column("panel_diff", lambda p: p.diff("sale", 1), f"{_r(f'sale - lag(sale) {_ID}')}")
_column("panel_pct_change", lambda p: p.pct_change("sale", 3), f"{_r(f'sale / nullif(lag(sale, 3) {_ID}, 0) - 1')}")
_column("row_count", lambda p: p.row_count(), f"cast(row_number() {_ID} - 1 as int)")
_column("row_count_desc", lambda p: p.row_count(False), "cast(row_number() over (partition by id order by date desc) - 1 as int)")


def _roll(fn: str, n: int, least: int, lag: int = 0, c: str = "ret") -> str:
    w = f"over (partition by id order by date rows between {n - 1 + lag} preceding and {lag} preceding)"
    return f"case when count({c}) {w} >= {least} then {_r(f'{fn}({c}) {w}')} end"


_column("roll_sum", lambda p: p.rolling("ret", 6, "sum"), _roll("sum", 6, 6))
_column("roll_mean_min", lambda p: p.rolling("ret", 12, "mean", 3), _roll("avg", 12, 3))
_column("roll_mean_lag", lambda p: p.rolling("ret", 12, "mean", 3, 2), _roll("avg", 12, 3, 2))
_column("roll_std", lambda p: p.rolling("ret", 12, "std", 6), _roll("stddev_samp", 12, 6))
_column("roll_var", lambda p: p.rolling("ret", 12, "var"), _roll("var_samp", 12, 12))
_column("cumret_6_1", lambda p: p.cumret("ret", 6, 1), f"case when count(ret) over (partition by id order by date rows between 5 preceding and 1 preceding) = 5 then {_r('exp(sum(ln(1 + ret)) over (partition by id order by date rows between 5 preceding and 1 preceding)) - 1')} end")
_column("cumret_12", lambda p: p.cumret("ret", 12), f"case when count(ret) over (partition by id order by date rows between 11 preceding and 0 preceding) = 12 then {_r('exp(sum(ln(1 + ret)) over (partition by id order by date rows between 11 preceding and 0 preceding)) - 1')} end")
_column("futret_1", lambda p: p.futret("ret"), f"{_r(f'lead(ret) {_ID}')}")
_AHEAD = "over (partition by id order by date rows between 1 following and 3 following)"
_column("futret_3", lambda p: p.futret("ret", 3), f"case when count(ret) {_AHEAD} = 3 and row_number() {_ID} > 2 then {_r(f'exp(sum(ln(1 + ret)) {_AHEAD}) - 1')} end")
_column("future_return_3", lambda p: p.future_return("ret", 3), f"case when count(ret) {_AHEAD} = 3 then {_r(f'exp(sum(ln(1 + ret)) {_AHEAD}) - 1')} end")
_column("nansum1", lambda p: sum_present(F.when(F.col("exchcd") != 1, F.col("ret")), F.when(F.col("exchcd") != 2, F.col("sale"))), _r("case when exchcd = 1 then sale when exchcd = 2 then ret else coalesce(ret, 0) + sale end"))
_column("near_zero", lambda p: F.when(is_zero("ret"), 0.0).otherwise(F.col("ret")), _r("case when abs(ret) < 1e-7 then 0 else ret end"))
_column("add_months", lambda p: (p, F.datediff(add_months(F.date_add("date", -5), 1), F.col("date"))), "cast(date_diff('day', date, last_day(date - interval 5 day)) as int)")
_column("rank_avg", lambda p: X.rank("cnt", ["date"]), "rank() over (partition by date order by cnt) + (count(*) over (partition by date, cnt) - 1) / 2")
_column("rank_pct", lambda p: X.rank("ret", ["date"], False, True), f"case when ret is not null then {_r('(rank() over (partition by date order by ret desc nulls last) + (count(*) over (partition by date, ret) - 1) / 2) / count(ret) over (partition by date)')} end")


@query(f"select id, date, case when row_number() {_ID} > 2 then sale end as sale, case when row_number() {_ID} > 2 then cnt end as cnt from pm")
def remove_rows(spark, sf_dir):
    return rounded(monthly(spark, sf_dir).remove_rows(2).df.select("id", "date", "sale", "cnt"))


@query("select id, date, sale, exchcd from pm where sale > 50000 and exchcd in (1, 2) and (ind <> 3 or ind is null)")
def panel_filter(spark, sf_dir):
    return monthly(spark, sf_dir).filter([("sale", ">", 50000.0), ("exchcd", "in", (1, 2)), ("ind", "!=", 3)]).df.select("id", "date", "sale", "exchcd")


@query("select id, date, case when ret > 0 or ret is null then sale end as sale from pm")
def panel_filter_keep_row(spark, sf_dir):
    return monthly(spark, sf_dir).filter([("ret", ">", 0.0)], keep_row=True).df.select("id", "date", "sale")


_GRID = "grid as (select id, last_day(cast(d as date)) as date from (select id, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), interval 1 month)) as d from pm where sale > 60000 group by id)) "
_ASOF = ", src as (select * from pm where sale > 60000), seen as (select g.id, g.date, s.date as src_date, s.sale, s.cnt from grid g asof left join src s on g.id = s.id and g.date >= s.date)"
_GAP = "(year(date) * 12 + month(date) - year(src_date) * 12 - month(src_date))"


def _sparse(spark, sf_dir) -> Panel:
    p = monthly(spark, sf_dir)
    return p.of(p.df.where("sale > 60000").select("id", "date", "sale", "cnt"))


@query(f", {_GRID} select g.id, g.date, s.sale, s.cnt from grid g left join (select * from pm where sale > 60000) s on g.id = s.id and g.date = s.date")
def populate_none(spark, sf_dir):
    return _sparse(spark, sf_dir).populate(MONTHLY).df


@query(f", {_GRID} {_ASOF} select id, date, case when {_GAP} <= 2 then sale end as sale, case when {_GAP} <= 2 then cnt end as cnt from seen")
def populate_ffill_limit(spark, sf_dir):
    return _sparse(spark, sf_dir).populate(MONTHLY, limit=2).df


@query(f", {_GRID} {_ASOF} select id, date, lag(case when {_GAP} <= 2 then sale end, 4) {_ID} as sale, lag(case when {_GAP} <= 2 then src_date end, 4) {_ID} as src_date from seen")
def populate_lag(spark, sf_dir):
    return _sparse(spark, sf_dir).populate(MONTHLY, limit=2, lag=4, source_date="src_date").df.select("id", "date", "sale", "src_date")


@query(f", n as (select *, (row_number() {_ID} - 1) % 12 as ph from pm) select id, date, case when count(sale) over w >= 2 then {_r('avg(sale) over w')} end as x, {_r(f'sale / nullif(lag(sale, 12) {_ID}, 0) - 1')} as g from n window w as (partition by id, ph order by date rows between 2 preceding and current row)")
def phase_rolling(spark, sf_dir):
    p = Panel(monthly(spark, sf_dir).df, freq=12, base_freq=1).numbered()
    return rounded(p.df.select("id", "date", p.rolling("sale", 3, "mean", 2).alias("x"), p.pct_change("sale").alias("g")))


_W24 = "over (partition by id order by date rows between 23 preceding and current row)"


@query(f"select id, date, case when n >= 12 then round(b, 6) end as beta, case when n >= 12 then round(r2, 6) end as r2, case when n >= 12 then round(sqrt(v * greatest(0, 1 - r2)), 6) end as ivol from (select id, date, count(case when ret is not null then cnt end) {_W24} as n, regr_slope(ret, cnt) {_W24} as b, regr_r2(ret, cnt) {_W24} as r2, var_samp(ret) {_W24} as v from pm)")
def rolling_ols(spark, sf_dir):
    p = monthly(spark, sf_dir)
    r = p.rolling_regression("ret", "cnt", 24, 12)
    return rounded(p.df.select("id", "date", *(r[k].alias(k) for k in ("beta", "r2", "ivol"))))


_W36 = "over (partition by id order by date rows between 35 preceding and current row)"
_TWO = "select id, date, case when (id + month(date)) % 7 <> 0 then ret end as y, cast(cnt as double) as a, qty / cnt as b from pm"
_SUMS = ", ".join(f"sum(case when y + a + b is not null then {x} end) {_W36} as s{k}" for k, x in {"n": "1", "y": "y", "a": "a", "b": "b", "yy": "y * y", "aa": "a * a", "bb": "b * b", "ab": "a * b", "ya": "y * a", "yb": "y * b"}.items())
_CENTRAL = ", ".join(f"s{i}{j} - s{i} * s{j} / sn as c{i}{j}" for i, j in ("yy", "aa", "bb", "ab", "ya", "yb"))


@query(f"""
, v as ({_TWO}), s as (select id, date, {_SUMS} from v), c as (select *, {_CENTRAL} from s where sn >= 24), d as (select *, caa * cbb - cab * cab as det from c),
b as (select *, (cya * cbb - cyb * cab) / det as ba, (cyb * caa - cya * cab) / det as bb from d where det > 1e-9 * caa * cbb),
r as (select *, ba * cya + bb * cyb as fit from b)
select v.id, v.date, round(sy / sn - ba * sa / sn - bb * sb / sn, 6) as const, round(ba, 6) as b_a, round(bb, 6) as b_b, round(fit / cyy, 6) as r2, round(sqrt(greatest(0, cyy - fit) / (sn - 1)), 6) as ivol
from v left join r using (id, date)""")
def rolling_ols_multi(spark, sf_dir):
    p = monthly(spark, sf_dir)
    df = p.df.selectExpr("id", "date", "case when (id + month(date)) % 7 <> 0 then ret end as y", "cast(cnt as double) as a", "qty / cnt as b")
    return rounded(rolling.rolling_regression(p.of(df), "y", ["a", "b"], 36, 24))


# Cross-section


def _cuts(qs: list[float], by: str = "me") -> str:
    return ", ".join(f"quantile_cont({by}, {q}) over (partition by date) as q{i}" for i, q in enumerate(qs))


def _cls(n: int, x: str = "me") -> str:
    return " + ".join(f"cast({x} > q{i} as int)" for i in range(n))


@query(f"select id, date, {_cls(4)} as cls from (select *, {_cuts([0.2, 0.4, 0.6, 0.8])} from pm)")
def classify_int(spark, sf_dir):
    return X.classify(monthly(spark, sf_dir).df, "me", 5, "cls", ["date"]).select("id", "date", "cls")


@query(f"select id, date, 2 - ({_cls(2)}) as cls from (select *, {_cuts([0.3, 0.7])} from pm)")
def classify_list_desc(spark, sf_dir):
    return X.classify(monthly(spark, sf_dir).df, "me", [0.3, 0.7, 1.0], "cls", ["date"], ascending=False).select("id", "date", "cls")


@query(f"select id, date, {_cls(2)} as cls from (select *, {_cuts([0.3, 0.7], 'case when exchcd = 1 then me end')} from pm)")
def classify_by(spark, sf_dir):
    return X.classify(monthly(spark, sf_dir).df, "me", [0.3, 0.7], "cls", ["date"], by=F.expr("case when exchcd = 1 then me end")).select("id", "date", "cls")


@query(f"select id, date, coalesce(ret >= q0 and ret <= q1, false) as keep from (select *, {_cuts([0.1, 0.9], 'ret')} from pm)")
def trim(spark, sf_dir):
    return X.trim(monthly(spark, sf_dir).df, "ret", (0.1, 0.1), "keep", ["date"]).select("id", "date", "keep")


@query(f"select id, date, me from (select *, {_cuts([0.2], 'case when exchcd = 1 then me end')} from pm) where me >= q0")
def filter_quantile(spark, sf_dir):
    return X.filter_quantile(monthly(spark, sf_dir).df, "me", (0.2, None), ["date"], by=F.expr("case when exchcd = 1 then me end")).select("id", "date", "me")


@query(f", q as (select *, {_cuts([0.05, 0.9], 'ret')} from pm), e as (select *, min(case when ret >= q0 then ret end) over (partition by date) as a, max(case when ret <= q1 then ret end) over (partition by date) as b from q) select id, date, case when ret is not null then round(greatest(least(ret, b), a), 6) end as x from e")
def winsorize(spark, sf_dir):
    return rounded(X.winsorize(monthly(spark, sf_dir).df, "ret", (0.05, 0.1), "x", ["date"]).select("id", "date", "x"))


def _avg_rank(x: str) -> str:
    return f"case when {x} is not null then rank() over (partition by date order by {x} nulls last) + (count(*) over (partition by date, {x}) - 1) / 2 end"


def _z(x: str) -> str:
    return f"({x} - avg({x}) over (partition by date)) / nullif(stddev_samp({x}) over (partition by date), 0)"


@query(f", r as (select id, date, {_avg_rank('cnt')} as ra, {_avg_rank('ret')} as rb from pm), z as (select id, date, {_z('ra')} as za, {_z('rb')} as zb from r), m as (select id, date, (coalesce(za, 0) + coalesce(zb, 0)) / nullif(cast(za is not null as int) + cast(zb is not null as int), 0) as mean from z), k as (select id, date, {_avg_rank('round(mean, 9)')} as rk from m) select id, date, round({_z('rk')}, 6) as x from k")
def zrank(spark, sf_dir):
    df = monthly(spark, sf_dir).df.select("id", "date", "cnt", "ret")
    return rounded(X.zrank(df, ["cnt", "ret"], "x", ["date"]).select("id", "date", "x"))


_BEYOND = {c: f"coalesce({c} < l{c} - (m{c} - l{c}) or {c} > u{c} + (u{c} - m{c}), false)" for c in ("sale", "b", "a")}
_BOUNDS = ", ".join(f"quantile_cont({c}, {q}) as {k}{c}" for c in ("sale", "b", "a") for k, q in (("l", 0.25), ("m", 0.5), ("u", 0.75)))
_CHANGES = f", d as (select id, date, sale, sale / nullif(lag(sale) {_ID}, 0) - 1 as b, sale / nullif(lead(sale) {_ID}, 0) - 1 as a from pm), s as (select {_BOUNDS}, count_if(sale < 0) / count(sale) as neg from d)"


@query(f"{_CHANGES} select id, date, {_BEYOND['b']} and {_BEYOND['a']} as odd from d, s")
def anomalies(spark, sf_dir):
    return X.anomalies(monthly(spark, sf_dir).df, "sale", "id", "date", "odd", tails=(0.25, 0.75)).select("id", "date", "odd")


@query(f"{_CHANGES} select id, date, ({_BEYOND['b']} and {_BEYOND['a']}) or {_BEYOND['sale']} or coalesce(sale < 0 and neg < 0.01, false) as odd from d, s")
def anomalies_any(spark, sf_dir):
    return X.anomalies(monthly(spark, sf_dir).df, "sale", "id", "date", "odd", ("change", "value", "negative"), (0.25, 0.75), rare_negative=0.01).select("id", "date", "odd")


# Analytics

_Q5 = f"c as (select *, {_cls(4)} as cls from (select *, {_cuts([0.2, 0.4, 0.6, 0.8])} from pm)) "
_WRET = "sum(ret * me) / nullif(sum(case when ret is not null then me end), 0)"


def _sorted(spark, sf_dir, n: int = 5):
    return X.classify(monthly(spark, sf_dir).df, "me", n, "cls", ["date"])


@query(f"select date, exchcd, round({_WRET}, 6) as ret, round(sum(prc * me) / sum(me), 6) as prc from pm group by date, exchcd")
def weighted_mean(spark, sf_dir):
    return rounded(A.weighted_mean(monthly(spark, sf_dir).df, ["ret", "prc"], "me", ["date", "exchcd"]))


_LS1 = "s as (select date, cls, {agg} from c where cls is not null group by date, cls), l as (select date, 5 as cls, max(case when cls = 0 then ret end) - max(case when cls = 4 then ret end) as ret from s group by date) select date, cls, round(ret, 6) as ret from (select date, cls, ret from s union all select date, cls, ret from l where ret is not null)"


@query(f", {_Q5}, {_LS1.format(agg=_WRET + ' as ret')}")
def one_dim_sort(spark, sf_dir):
    return rounded(A.one_dim_sort(_sorted(spark, sf_dir), "date", "cls", ["ret"], "me"))


@query(f", {_Q5} select date, cls, round(avg(ret), 6) as ret_mean, round(stddev_samp(ret), 6) as ret_std, count(ret) as ret_count from c group by date, cls")
def one_dim_sort_multi(spark, sf_dir):
    return rounded(A.one_dim_sort(_sorted(spark, sf_dir), "date", "cls", ["ret"], None, ["mean", "std", "count"], False))


_Q32 = f"c as (select *, {_cls(2)} as c1 from (select *, {_cuts([1 / 3, 2 / 3])} from pm)), d as (select *, cast(prc > r0 as int) as c2 from (select *, quantile_cont(prc, 0.5) over (partition by date) as r0 from c)), s as (select date, c1, c2, {_WRET} as ret from d group by date, c1, c2) "


def _two(spark, sf_dir):
    df = X.classify(monthly(spark, sf_dir).df, "me", 3, "c1", ["date"])
    return X.classify(df, "prc", 2, "c2", ["date"])


@query(f", {_Q32}, l1 as (select date, 3 as c1, c2, max(case when c1 = 0 then ret end) - max(case when c1 = 2 then ret end) as ret from s group by date, c2), a as (select * from s union all select * from l1 where ret is not null), l2 as (select date, c1, 2 as c2, max(case when c2 = 0 then ret end) - max(case when c2 = 1 then ret end) as ret from a group by date, c1) select date, c1, c2, round(ret, 6) as ret from (select * from a union all select * from l2 where ret is not null)")
def two_dim_sort(spark, sf_dir):
    return rounded(A.two_dim_sort(_two(spark, sf_dir), "date", "c1", "c2", ["ret"], "me"))


@query(f", {_Q32} select date, c1, round(max(case when c2 = 0 then ret end), 6) as \"0\", round(max(case when c2 = 1 then ret end), 6) as \"1\" from s group by date, c1")
def two_dim_pivot(spark, sf_dir):
    return rounded(A.pivoted(A.two_dim_sort(_two(spark, sf_dir), "date", "c1", "c2", ["ret"], "me", long_short=False), "date", "c1", "c2", "ret", [0, 1]))


@query(f", {_Q5} select id, date, case cls when 0 then 'low' when 1 then 'b' when 2 then 'c' when 3 then 'd' when 4 then 'high' end as cls from c")
def relabel_class(spark, sf_dir):
    return A.relabel(_sorted(spark, sf_dir), "cls", ["low", "b", "c", "d", "high"]).select("id", "date", "cls")


@query(f", {_Q5}, s as (select date, cls, avg(ret) as ret from c group by date, cls) select cls, round(avg(ret), 6) as ret_mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 5) as ret_t from s group by cls")
def t_stat(spark, sf_dir):
    s = A.one_dim_sort(_sorted(spark, sf_dir), "date", "cls", ["ret"], long_short=False)
    return A.t_stat(s, "date", ["ret"], ["cls"]).select("cls", F.round("ret_mean", 6).alias("ret_mean"), F.round("ret_t", 5).alias("ret_t"))


_HAC = " + ".join(f"2 * (1 - {k} / 5.0) * coalesce(sum(e * e{k}), 0)" for k in range(1, 5))


@query(f", {_Q5}, s as (select date, cls, avg(ret) as ret from c group by date, cls), e as (select cls, date, ret, ret - avg(ret) over (partition by cls) as e from s where ret is not null), l as (select *, {', '.join(f'lag(e, {k}) over (partition by cls order by date) as e{k}' for k in range(1, 5))} from e) select cls, round(avg(ret), 6) as ret_mean, round(avg(ret) * count(ret) / sqrt(sum(e * e) + {_HAC}), 5) as ret_t from l group by cls")
def t_stat_hac(spark, sf_dir):
    s = A.one_dim_sort(_sorted(spark, sf_dir), "date", "cls", ["ret"], long_short=False)
    return A.t_stat(s, "date", ["ret"], ["cls"], lags=4).select("cls", F.round("ret_mean", 6).alias("ret_mean"), F.round("ret_t", 5).alias("ret_t"))


@query("select round(avg(a), 6) as b_const_mean, round(avg(a) / (stddev_samp(a) / sqrt(count(a))), 4) as b_const_t, round(avg(b), 9) as b_prc_mean, round(avg(b) / (stddev_samp(b) / sqrt(count(b))), 4) as b_prc_t from (select date, regr_intercept(ret, prc) as a, regr_slope(ret, prc) as b from pm where ret is not null and prc is not null group by date having count(*) > 2)")
def fama_macbeth(spark, sf_dir):
    r = A.fama_macbeth(monthly(spark, sf_dir).df, "date", "ret", ["prc"])
    return r.select(*(F.round(c, 6 if c == "b_const_mean" else 9 if c.endswith("mean") else 4).alias(c) for c in r.columns))


@query()
def fama_macbeth_multi(spark, sf_dir):
    df = monthly(spark, sf_dir).df.withColumn("lnme", F.ln("me"))
    return A.fama_macbeth(df, "date", "ret", ["prc", "lnme", "cnt"], lags=12)


@query()
def grs_test(spark, sf_dir):
    s = A.one_dim_sort(_sorted(spark, sf_dir, 3), "date", "cls", ["ret"], long_short=False)
    assets = s.groupBy("date").pivot("cls", [0, 1, 2]).agg(F.first("ret"))
    market = A.weighted_mean(monthly(spark, sf_dir).df, ["ret"], "me", ["date"])
    r = A.grs_test(assets, market, "date")
    return spark.createDataFrame([(r["grs"], r["p"])], "grs double, p double")


@query("select exchcd, round(skewness(ret), 6) as skew from pm group by exchcd")
def skewness(spark, sf_dir):
    return rounded(monthly(spark, sf_dir).df.groupBy("exchcd").agg(sample_skewness("ret").alias("skew")))


# Joins

_LEFT = "l as (select id, date, sale, me from pm where exchcd = 1), r as (select id, date, sale * 2 as sale, cnt from pm where month(date) <= 6) "


def _sides(spark, sf_dir):
    df = monthly(spark, sf_dir).df
    return df.where("exchcd = 1").select("id", "date", "sale", "me"), df.where("month(date) <= 6").select("id", "date", (F.col("sale") * 2).alias("sale"), "cnt")


def _merge(name: str, how: str, drop: str | None, sql: str):
    query(f", {_LEFT} {sql}", name)(lambda spark, sf_dir: J.merge(*_sides(spark, sf_dir), ["id", "date"], how, drop))


_merge("merge_left", "left", "right", "select id, date, l.sale, me, cnt from l left join r using (id, date)")
_merge("merge_inner", "inner", "left", "select id, date, me, r.sale, cnt from l join r using (id, date)")
_merge("merge_outer", "full", None, "select id, date, l.sale as sale_x, me, r.sale as sale_y, cnt from l full join r using (id, date)")
_merge("merge_right", "right", "right", "select id, date, l.sale, me, cnt from l right join r using (id, date)")

_LINK = "link as (select o_custkey as key, cast(o_orderdate as date) as linkdt, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 200 as int) end as linkend, max(o_totalprice) as price from {orders} group by all) "
_PROBE = "probe as (select o_orderkey as oid, o_custkey as key, cast(o_orderdate as date) + 90 as date from {orders}) "


def _links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    link = o.groupBy(F.col("o_custkey").alias("key"), d.alias("linkdt"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(d, (F.col("o_orderkey") % 200).cast("int"))).alias("linkend")).agg(F.max("o_totalprice").alias("price"))
    # Of links that start on one day the dearest stands.
    link = link.groupBy("key", "linkdt").agg(F.max(F.struct("price", "linkend")).alias("m")).select("key", "linkdt", "m.linkend", "m.price")
    return o.select(F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("key"), F.date_add(d, 90).alias("date")), link


_ONE = ", one as (select key, linkdt, linkend, price from (select *, row_number() over (partition by key, linkdt order by price desc, linkend desc nulls last) as rn from link) where rn = 1) "


@query(f", {_LINK}, {_PROBE} {_ONE} select oid, p.key, date, case when linkend is null or date <= linkend then price end as price from probe p asof left join one l on p.key = l.key and p.date >= l.linkdt")
def asof_link(spark, sf_dir):
    probe, link = _links(spark, sf_dir)
    return J.asof(probe, link, "key", "date", "linkdt", "linkend", ["price"])


@query(f", {_LINK}, {_PROBE} {_ONE} select oid, p.key, date, price from probe p left join one l on p.key = l.key and date >= linkdt and (linkend is null or date <= linkend)")
def interval_join(spark, sf_dir):
    probe, link = _links(spark, sf_dir)
    return J.interval(probe, link, "key", "date", "linkdt", "linkend")


@query(", s as (select id, date, case when ind % 4 <> 0 then ind end as firm, exchcd as grp, id % 7 = 0 as linked, sale from pm), a as (select *, linked or (firm is not null and count(*) over (partition by date, firm) = 1) as p1 from s), b as (select *, p1 or (firm is not null and sum(cast(p1 as int)) over (partition by date, firm) = 0 and sale = max(sale) over (partition by date, firm)) as p2 from a) select id, date, p2 or (firm is null and sum(cast(p2 as int)) over (partition by date, grp) = 0 and sale = max(sale) over (partition by date, grp)) as prim from b")
def primary_stock(spark, sf_dir):
    df = monthly(spark, sf_dir).df.select("id", "date", F.expr("case when ind % 4 <> 0 then ind end").alias("firm"), F.col("exchcd").alias("grp"), (F.col("id") % 7 == 0).alias("linked"), "sale")
    return J.primary(df, "date", "firm", "grp", "linked", "sale", "prim").select("id", "date", "prim")


@query(", a as (select id, date, cast(year(date) as int) as age, case when cnt > 3 then sale end as sale, net from pm where month(date) > 2), q as (select id, date, cast(year(date) + id % 2 as int) as age, sale * 3 as sale, case when cnt > 2 then net end as net from pm where month(date) < 11), j as (select coalesce(a.id, q.id) as id, coalesce(a.date, q.date) as date, a.id is null or coalesce(a.age < q.age, false) as newer, a.age, q.age as qage, a.sale, q.sale as qsale, a.net, q.net as qnet from a full join q on a.id = q.id and a.date = q.date) select id, date, case when (newer or age is null) and qage is not null then qage else age end as age, case when (newer or sale is null) and qsale is not null then qsale else sale end as sale, case when (newer or net is null) and qnet is not null then qnet else net end as net from j")
def fill_merge(spark, sf_dir):
    df = monthly(spark, sf_dir).df
    a = df.where("month(date) > 2").select("id", "date", F.year("date").alias("age"), F.expr("case when cnt > 3 then sale end").alias("sale"), "net")
    q = df.where("month(date) < 11").select("id", "date", F.expr("cast(year(date) + id % 2 as int)").alias("age"), (F.col("sale") * 3).alias("sale"), F.expr("case when cnt > 2 then net end").alias("net"))
    return J.fill_outer(a, q, ["id", "date"], "age")


_DUP = "d as (select l_suppkey as id, year(l_shipdate) as y, case when l_linenumber < 6 then l_linenumber end as fq, month(l_shipdate) as fy, l_orderkey as k from {lineitem})"


@query(f", {_DUP}, a as (select *, max(fy) over (partition by id, y) as my from d where fq is not null), b as (select *, min(fq) over (partition by id, y) as mq from a where fy = my) select id, y, fy, fq, k from b where fq = mq")
def remove_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").cast("long").alias("y"), F.expr("case when l_linenumber < 6 then l_linenumber end").alias("fq"), F.month("l_shipdate").cast("long").alias("fy"), F.col("l_orderkey").alias("k"))
    return J.remove_duplicates(d, ["id", "y"], "fy", "fq").select("id", "y", "fy", "fq", "k")


@query(f", y as (select id, date, cast(month(date) as int) as fq, sum(sale) over (partition by id, year(date) order by date) as ytd from pm) select id, date, round(case when fq = 1 then ytd else ytd - lag(ytd) {_ID} end, 4) as flow from y")
def quarterise_ytd(spark, sf_dir):
    df = monthly(spark, sf_dir).df.withColumns({"fq": F.month("date"), "ytd": F.sum("sale").over(W.partitionBy("id", F.year("date")).orderBy("date"))})
    return rounded(J.quarterise(df, "id", "date", "fq", "ytd", "flow").select("id", "date", "flow"), 4)


@query(", y as (select id, date, sale as x, case when cnt > 2 then sale * (1 + (id % 3) / 100.0) end as y from pm) select 'sale' as \"column\", round(avg(case when y is not null then cast(abs(x - y) <= 0.01 * abs(y) or (abs(x) < 1e-5 and abs(y) < 1e-5) as int) end), 6) as match, round(corr(x, y), 6) as corr, cast(count_if(x is null) as bigint) as null_x, cast(count_if(y is null) as bigint) as null_y from y")
def compare_data(spark, sf_dir):
    df = monthly(spark, sf_dir).df
    other = df.select("id", "date", F.expr("case when cnt > 2 then sale * (1 + cast(id % 3 as double) / 100) end").alias("sale"))
    out = J.compare(df.select("id", "date", "sale"), other, ["id", "date"])
    return rounded(out)


@query("select 'ret' as \"column\", count(*) as \"rows\", cast(count_if(ret is null) as bigint) as nulls, cast(0 as bigint) as infs, round(avg(ret), 6) as mean, round(stddev_samp(ret), 6) as std, round(min(ret), 6) as min, round(quantile_cont(ret, 0.001), 6) as p0_1, round(quantile_cont(ret, 0.01), 6) as p1, round(quantile_cont(ret, 0.25), 6) as p25, round(quantile_cont(ret, 0.5), 6) as p50, round(quantile_cont(ret, 0.75), 6) as p75, round(quantile_cont(ret, 0.99), 6) as p99, round(quantile_cont(ret, 0.999), 6) as p99_9, round(max(ret), 6) as max, count(distinct date) as dates, count(distinct id) as ids from pm")
def inspect_data(spark, sf_dir):
    return rounded(J.inspect(monthly(spark, sf_dir).df.select("id", "date", "ret"), "date", "id"))


@query("select date, count(*) as n from pm group by date")
def ids_by_date(spark, sf_dir):
    return J.ids_by_date(monthly(spark, sf_dir).df, "date")


# Portfolios

_POS = f"{_Q5}, pos as (select cls as pf, date, id, ret, me / sum(me) over (partition by cls, date) as wgt from c where ret is not null and cls is not null) "


def _position(spark, sf_dir):
    return P.make_position(_sorted(spark, sf_dir), "ret", "me", "cls")


@query(f", {_POS} select pf, date, id, round(ret, 6) as ret, round(wgt, 6) as wgt from pos")
def make_position(spark, sf_dir):
    return rounded(_position(spark, sf_dir))


_PF = f"""{_POS}, b as (select pf, date, sum(wgt * ret) as r, sum(case when wgt > 0 then wgt else 0 end) as lw, cast(count_if(wgt > 0) as bigint) as n_long, cast(count_if(wgt < 0) as bigint) as n_short from pos group by pf, date),
 v as (select *, exp(sum(ln(1 + r)) over (partition by pf order by date)) as value, lead(date) over (partition by pf order by date) as nxt, row_number() over (partition by pf order by date) = 1 as fst from b),
 v0 as (select *, coalesce(lag(value) over (partition by pf order by date), 1) as value0 from v),
 held as (select pos.*, value0, nxt from pos join v0 using (pf, date)),
 tr as (select pf, date, id, sum(a) as a, sum(b) as b from (select pf, date, id, wgt * value0 as a, 0 as b from held union all select pf, nxt, id, 0, wgt * value0 * (1 + ret) from held where nxt is not null) group by pf, date, id),
 am as (select pf, date, sum(abs(a - b)) as amount from tr group by pf, date),
 pr as (select pf, date, r as gross_ret, case when fst then 0 else amount / value0 end as turnover, n_long, n_short, value from v0 join am using (pf, date)),
 net as (select *, gross_ret - 0.002 * turnover as net_ret from pr) """


@query(f", {_PF} select pf, date, round(gross_ret, 6) as gross_ret, round(net_ret, 6) as net_ret, round(value, 6) as value, round(turnover, 6) as turnover, n_long, n_short from net")
def portfolio_returns(spark, sf_dir):
    return rounded(P.portfolio_returns(_position(spark, sf_dir), cost=0.002).select("pf", "date", "gross_ret", "net_ret", "value", "turnover", "n_long", "n_short"))


_DD = f"""{_PF}, cu as (select *, sum(ln(1 + net_ret)) over (partition by pf order by date) as cum, row_number() over (partition by pf order by date) as t from net),
 pk as (select *, greatest(0, max(cum) over (partition by pf order by date)) as peak from cu),
 dd as (select *, t - coalesce(last_value(case when cum >= peak then t end ignore nulls) over (partition by pf order by date), 0) as duration, 1 - exp(cum - peak) as drawdown, greatest(0, 1 - exp(cum - coalesce(last_value(case when net_ret > 0 then cum end ignore nulls) over (partition by pf order by date), 0))) as succdown from pk) """


@query(f", {_DD} select pf, date, round(cum, 6) as cum, round(drawdown, 6) as drawdown, duration, round(succdown, 6) as succdown from dd")
def drawdown(spark, sf_dir):
    d = P.drawdowns(P.portfolio_returns(_position(spark, sf_dir), cost=0.002), "net_ret")
    return rounded(d.select("pf", "date", "cum", "drawdown", F.col("duration").cast("long").alias("duration"), "succdown"))


@query(f", {_DD} select pf, count(*) as periods, round(avg(net_ret) * 12, 6) as mean, round(stddev_pop(net_ret) * sqrt(12), 6) as std, round(avg(net_ret) / stddev_pop(net_ret) * sqrt(12), 6) as sharpe, round(max_by(cum, date), 6) as cum_ret, round(max(drawdown), 6) as mdd, round(max(succdown), 6) as msd, round(avg(turnover) * 12, 6) as turnover from dd group by pf")
def evaluate(spark, sf_dir):
    e = P.evaluate(P.portfolio_returns(_position(spark, sf_dir), cost=0.002))
    return rounded(e.select("pf", "periods", "mean", "std", "sharpe", "cum_ret", "mdd", "msd", "turnover"))


@query(f", {_PF}, lo as (select pf, date, gross_ret from net where pf in (0, 4)) select date, round(sum(case when pf = 0 then gross_ret else -gross_ret end), 5) as r from lo group by date having count(*) = 2")
def long_short(spark, sf_dir):
    pos = _position(spark, sf_dir)
    both = P.long_short(pos, 0, 4, 9)
    dates = both.groupBy("date").agg(F.sum(F.col("wgt") * F.col("ret")).alias("r"), F.count_if(F.col("wgt") > 0).alias("a"), F.count_if(F.col("wgt") < 0).alias("b")).where("a > 0 and b > 0")
    return dates.select("date", F.round("r", 5).alias("r"))


@query("select id, date, round(greatest(1, least(4, 4 - 3 * date_diff('day', date '1974-01-01', date) / date_diff('day', date '1974-01-01', date '2002-01-01'))) * (0.006 - 0.0025 * (me - min(me) over (partition by date)) / nullif(max(me) over (partition by date) - min(me) over (partition by date), 0)), 6) as cost from pm")
def time_varying_cost(spark, sf_dir):
    return rounded(P.time_varying_cost(monthly(spark, sf_dir).df, "me", "date").select("id", "date", "cost"))


@query(f", {_DD}, e as (select pf, date, cum, avg(net_ret) over w as m, stddev_pop(net_ret) over w as s, max(drawdown) over w as mdd, max(succdown) over w as msd, avg(turnover) over w as t from dd window w as (partition by pf order by date)) select pf, date, round(m * 12, 6) as mean, round(s * sqrt(12), 6) as std, round(case when s = 0 then 0 else m / s end * sqrt(12), 5) as sharpe, round(cum, 6) as cum_ret, round(mdd, 6) as mdd, round(msd, 6) as msd, round(t * 12, 6) as turnover from e")
def evaluate_series(spark, sf_dir):
    e = P.evaluate_series(P.portfolio_returns(_position(spark, sf_dir), cost=0.002))
    return rounded(e.select("pf", "date", "mean", "std", "cum_ret", "mdd", "msd", "turnover", F.round("sharpe", 5).alias("sharpe")))


#: Events of two thirds of all months of all ids; codes of the exchange are missing at times, there and in the stocks.
_MOMENTS = {"dlret": "cast(case when cnt % 3 = 0 then -0.1 end as double)", "dlstcd": "cast(case when (cnt + id) % 4 = 0 then 400 + (id * 7 + month(date) * 31) % 190 end as double)", "exchcd": "cast(case when (id + month(date)) % 4 = 1 then exchcd end as double)", "distcd": "cast(1000 + (id * 31 + month(date)) % 600 as double)", "divamt": "sale / 1000"}
_EVENTS = f"select id, date, {', '.join(f'{v} as {k}' for k, v in _MOMENTS.items())} from pm where (id + month(date)) % 3 <> 0"
_CODED = "select id, date, ret, cast(case when (id + month(date)) % 5 in (0, 3) then exchcd end as double) as exchcd, case when month(date) % 4 = 0 then 10 + id % 3 end as shrcd from pm"


def _delisting_sql(fill: str) -> str:
    carry = f"last_value(%s ignore nulls) {_ID}"
    return f""", sk as (select id, date, ret, {carry % 'exchcd'} as exchcd, {carry % 'shrcd'} as shrcd from ({_CODED}) s), ev as ({_EVENTS}),
 ex as (select ev.* exclude (exchcd), coalesce(ev.exchcd, k.exchcd) as exchcd from ev asof left join (select * from sk where exchcd is not null) k on ev.id = k.id and ev.date >= k.date),
 dl as (select id, date, coalesce(dlret, case when dlstcd = 500 or dlstcd between 520 and 584 then {fill} end) as dlret from ex where dlstcd is not null),
 ca as (select id, date, case when floor(distcd / 100) % 10 in (2, 3) then divamt else 0 end as cash_div from ex)
 select sk.id, sk.date, round(case when coalesce(ret, dlret) is not null then (1 + coalesce(ret, 0)) * (1 + coalesce(dlret, 0)) - 1 end, 6) as ret, round(dlret, 6) as dlret, round(cash_div, 6) as cash_div, exchcd, cast(shrcd as int) as shrcd from sk left join dl using (id, date) left join ca using (id, date)"""


def _delisted(spark, sf_dir, method: int):
    pm = monthly(spark, sf_dir).df
    stocks, events = (spark.sql(x.replace("from pm", "from {pm}"), pm=pm) for x in (_CODED, _EVENTS))
    out = J.delisting_returns(stocks, events, "id", "date", method, ("exchcd", "shrcd"))
    return rounded(out.select("id", "date", "ret", "dlret", "cash_div", "exchcd", F.col("shrcd").cast("int").alias("shrcd")))


@query(_delisting_sql("-0.30"))
def delisting_returns_1(spark, sf_dir):
    return _delisted(spark, sf_dir, 1)


@query(_delisting_sql("case when exchcd in (1, 2) then -0.35 when exchcd = 3 then -0.55 end"))
def delisting_returns(spark, sf_dir):
    return _delisted(spark, sf_dir, 2)


_CUR = "case id % 3 when 0 then 'USD' when 1 then 'CAD' else 'EUR' end"


@query(f", r as (select date, 1.2 + month(date) / 50.0 as usd, 1.7 + year(date) % 10 / 20.0 as cad from (select distinct date from pm)), f as (select id, date, sale, {_CUR} as cur from pm) select id, date, cur, round(case when cur = 'USD' then sale when cur = 'CAD' then sale * usd / cad end, 4) as sale from f join r using (date)")
def currency_to_usd(spark, sf_dir):
    df = monthly(spark, sf_dir).df
    dates = df.select("date").distinct()
    rates = dates.selectExpr("date as datadate", "'USD' as tocurd", "cast(1.2 as double) + month(date) / cast(50 as double) as exratd").unionByName(dates.selectExpr("date as datadate", "'CAD' as tocurd", "cast(1.7 as double) + (year(date) % 10) / cast(20 as double) as exratd"))
    f = df.select("id", "date", "sale", F.expr(_CUR).alias("cur"))
    return rounded(J.to_usd(f, rates, "date", "cur", ["sale"]).select("id", "date", "cur", "sale"), 4)


# Daily rows by month: partial sums per month, then a range of months.


@query(", q as (select id, year(date) * 12 + month(date) as mon, day(date) % 5 as d, value from pd) select id, d, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(max(value), 6) as top from q group by id, d")
def daily_groups(spark, sf_dir):
    df = frame(spark, sf_dir, PD)
    return rounded(df.groupBy("id", (F.dayofmonth("date") % 5).cast("long").alias("d")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("top")))


@query(f", {_Q5}, {_LS1.format(agg=_WRET + ' as ret')}", "flagship")
def flagship(spark, sf_dir):
    """Value-weighted quintile returns with long-short."""
    return one_dim_sort(spark, sf_dir)


def yearly_growth(spark, sf_dir):
    p = yearly(spark, sf_dir)
    return rounded(p.df.select("id", "date", p.pct_change("sale").alias("x")))


query(f"select id, date, {_r(f'sale / nullif(lag(sale) {_ID}, 0) - 1')} as x from pa")(yearly_growth)
