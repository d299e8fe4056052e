"""Portfolios: positions, returns, costs and evaluation, for all portfolios of a table at once, keyed by a portfolio column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import div
from quantloom.operators.joins import asof


def make_position(df: DataFrame, ret: str, weight: str | None, pf: str | None = None, date: str = "date", id: str = "id", others: list[str] = []) -> DataFrame:  # noqa: B006
    """pf, date, id, ret, wgt: rows with a return and a weight; weights add up to one per portfolio and date. Without pf there is one portfolio, 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    key = F.col(pf) if pf else F.lit(0)
    rows = df.select(key.alias("pf"), date, id, F.col(ret).cast("double").alias("ret"), w.alias("wgt"), *others).na.drop(subset=["pf", "ret", "wgt"])
    return rows.withColumn("wgt", div("wgt", F.sum("wgt").over(W.partitionBy("pf", date))))


def long_short(position: DataFrame, long_pf, short_pf, pf, weights: tuple[float, float] = (1.0, -1.0)) -> DataFrame:
    """The position of a portfolio `pf` that holds two others, scaled."""
    of = lambda k, w: position.where(F.col("pf") == F.lit(k)).withColumns({"pf": F.lit(pf), "wgt": F.col("wgt") * w})
    return of(long_pf, weights[0]).unionByName(of(short_pf, weights[1]))


_POWERS = ("fixed", "linear", "quad")


@dataclass(frozen=True)
class Costs:
    """What a trade costs, in value: a fixed part, one linear and one quadratic in the amount traded, for buys and for sells.

    The parts are numbers, or columns of a table with a row for each of its keys `by`, (id,) or (date, id). carried: a row holds until
    the id's next one, so a trade takes the latest row up to its date; else only a row of that date. A trade without a row or with a
    null part costs nothing for it, and what isn't traded costs nothing.
    """

    buy: dict[str, float | str]
    sell: dict[str, float | str]
    table: DataFrame | None = None
    by: tuple[str, ...] = ()
    carried: bool = False

    @classmethod
    def of(cls, cost: float | None = None, **parts: float) -> Costs:
        """A rate of the amount, or parts: buy_fixed, buy_linear, buy_quad, sell_fixed, sell_linear, sell_quad."""
        if wrong := parts.keys() - {f"{s}_{p}" for s in ("buy", "sell") for p in _POWERS}:
            raise ValueError(f"no such costs: {', '.join(sorted(wrong))}")
        if cost is not None:
            return cls({"linear": cost}, {"linear": cost})
        return cls(*({p: parts[f"{s}_{p}"] for p in _POWERS if f"{s}_{p}" in parts} for s in ("buy", "sell")))

    @classmethod
    def of_table(cls, table: DataFrame, by: tuple[str, ...], carried: bool = False) -> Costs:
        """Columns of the table: cost, a rate of the amount, or those that of() takes."""
        if carried and len(by) != 2:
            raise ValueError("only rows by date and id can be carried")
        if "cost" in table.columns:
            return cls({"linear": "cost"}, {"linear": "cost"}, table, by, carried)
        return cls(*({p: f"{s}_{p}" for p in _POWERS if f"{s}_{p}" in table.columns} for s in ("buy", "sell")), table, by, carried)

    def _amount(self, side: dict[str, float | str], x: Column) -> Column:
        part = lambda v: F.coalesce(F.col(f"_c_{v}").cast("double"), F.lit(0.0)) if isinstance(v, str) else F.lit(float(v))
        return sum((part(v) * {"fixed": F.lit(1.0), "linear": x, "quad": x * x}[k] for k, v in side.items()), F.lit(0.0))

    def priced(self, trades: DataFrame, date: str, id: str, out: str = "cost") -> DataFrame:
        """trades (values `before` and `after` by date and id) with what each costs."""
        keep, x = trades.columns, F.abs(F.col("after") - F.col("before"))
        names = sorted({v for v in (*self.buy.values(), *self.sell.values()) if isinstance(v, str)})
        if self.table is not None:
            rates = self.table.select(*self.by, *(F.col(c).alias(f"_c_{c}") for c in names))
            if self.carried:
                trades = asof(trades, rates.withColumnRenamed(date, "_since"), id, date, "_since", values=[f"_c_{c}" for c in names])
            else:
                trades = trades.join(rates, list(self.by), "left")
        cost = F.when(F.col("after") > F.col("before"), self._amount(self.buy, x)).when(F.col("after") < F.col("before"), self._amount(self.sell, x)).otherwise(0.0)
        return trades.select(*keep, cost.alias(out))


def time_varying_cost(df: DataFrame, me: str, date: str, out: str = "cost") -> DataFrame:
    """Cost by size and date: falls with size, and by date from four times at the start of 1974 to once in 2002."""
    w = W.partitionBy(date)
    size = div(F.col(me) - F.min(me).over(w), F.max(me).over(w) - F.min(me).over(w))
    days = lambda d: F.datediff(F.lit(d).cast("date"), F.lit("1974-01-01").cast("date"))
    y = F.greatest(F.lit(1.0), F.least(F.lit(4.0), 4 - 3 * F.datediff(F.col(date), F.lit("1974-01-01").cast("date")) / days("2002-01-01")))
    return df.withColumn(out, y * (0.006 - 0.0025 * size))


def _log_growth(ret: str) -> Column:
    """ln(1 + ret) as floating point has it: minus infinity where all is lost, NaN beyond. F.log1p gives null there, which sums leave out."""
    r = F.col(ret).cast("double")
    return F.when(r > -1, F.log1p(r)).when(r == -1, F.lit(float("-inf"))).when(r < -1, F.lit(float("nan")))


def portfolio_returns(position: DataFrame, rf: str | None = None, date: str = "date", id: str = "id", cost: str | float | Costs | Callable[[Column, Column], Column] | None = None, start: float = 1.0) -> DataFrame:
    """pf, date, gross_ret, net_ret, excess, net_excess, value, n_long, n_short, turnover, cost.

    What the long positions leave of the value is cash, at rf if there is a column of it. Weights are at the date's start, returns
    over the date; a name that is not held any more is sold. The excess return is the positions' plus the cash's return. cost: a rate
    of the amount traded, as a number or a column; Costs; or a function of the values after and before a trade. `start` is the first
    value, which counts where costs aren't linear; the first date's trades are free.
    """
    rate = F.col(rf).cast("double") if rf else F.lit(0.0)
    by = position.groupBy("pf", date).agg(
        F.sum(F.col("wgt") * F.col("ret")).alias("_r"), F.sum(F.col("wgt") * (F.col("ret") - rate)).alias("_e"), F.sum(F.when(F.col("wgt") > 0, F.col("wgt")).otherwise(0.0)).alias("_long"), F.max(rate).alias("_rf"),
        F.count_if(F.col("wgt") > 0).alias("n_long"), F.count_if(F.col("wgt") < 0).alias("n_short"))
    over = W.partitionBy("pf").orderBy(date)
    run = over.rowsBetween(W.unboundedPreceding, 0)
    by = by.withColumn("gross_ret", F.col("_r") + (1 - F.col("_long")) * F.col("_rf"))
    by = by.withColumn("value", start * F.exp(F.sum(_log_growth("gross_ret")).over(run)))
    by = by.withColumns({"_value0": F.coalesce(F.lag("value").over(over), F.lit(start)), "_next": F.lead(date).over(over), "_first": F.row_number().over(over) == 1})
    held = position.join(by.select("pf", date, "_value0", "_next", "_first"), ["pf", date])
    own = F.col(cost).cast("double") if isinstance(cost, str) else F.lit(None).cast("double")
    val = F.col("wgt") * F.col("_value0")
    now = held.select("pf", date, id, val.alias("after"), own.alias("rate"), F.lit(0.0).alias("before"))
    then = held.where(F.col("_next").isNotNull()).select("pf", F.col("_next").alias(date), id, F.lit(0.0).alias("after"), F.lit(None).cast("double").alias("rate"), (val * (1 + F.col("ret"))).alias("before"))
    trades = now.unionByName(then).groupBy("pf", date, id).agg(F.sum("after").alias("after"), F.sum("before").alias("before"), F.max("rate").alias("rate"))
    amount = F.abs(F.col("after") - F.col("before"))
    if isinstance(cost, str):
        trades = trades.withColumn("cost", amount * F.coalesce("rate", F.lit(0.0)))
    elif callable(cost):
        trades = trades.withColumn("cost", cost(F.col("after"), F.col("before")))
    else:
        trades = (cost if isinstance(cost, Costs) else Costs.of(float(cost or 0.0))).priced(trades, date, id)
    traded = trades.groupBy("pf", date).agg(F.sum(amount).alias("_amount"), F.sum("cost").alias("_cost"))
    out = by.join(traded, ["pf", date])
    out = out.withColumns({"turnover": F.when(F.col("_first"), 0.0).otherwise(div("_amount", "_value0")), "cost": F.when(F.col("_first"), 0.0).otherwise(div("_cost", "_value0"))})
    out = out.withColumns({"net_ret": F.col("gross_ret") - F.col("cost"), "excess": F.col("_e") + (1 - F.col("_long")) * F.col("_rf")})
    out = out.withColumn("net_excess", F.col("excess") - F.col("cost"))
    return out.select("pf", date, "gross_ret", "net_ret", "excess", "net_excess", "value", "n_long", "n_short", "turnover", "cost")


def from_returns(returns: DataFrame, ret: str, pf: str = "pf", date: str = "date", start: float = 1.0) -> DataFrame:
    """Returns that are known, as portfolio_returns() gives them: one name held, no trades, no risk-free rate."""
    run = W.partitionBy("pf").orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    rows = returns.select(F.col(pf).alias("pf"), date, F.col(ret).cast("double").alias("_r")).where("_r is not null")
    same = [F.col("_r").alias(c) for c in ("gross_ret", "net_ret", "excess", "net_excess")]
    return rows.select("pf", date, *same, (start * F.exp(F.sum(_log_growth("_r")).over(run))).alias("value"), F.lit(1).cast("long").alias("n_long"), F.lit(0).cast("long").alias("n_short"), F.lit(0.0).alias("turnover"), F.lit(0.0).alias("cost"))


#: Kind of return -> the columns that cumulative returns and losses, and that means, deviations and Sharpe ratios are of.
RETURN_TYPES = {
    "net": ("net_ret", "net_excess"), "gross": ("gross_ret", "excess"), "netexret": ("net_excess", "net_excess"),
    "grossexret": ("excess", "excess"), "netret": ("net_ret", "net_ret"), "grossret": ("gross_ret", "gross_ret"),
}


def drawdowns(returns: DataFrame, ret: str, pf: str = "pf", date: str = "date") -> DataFrame:
    """returns with cum (log), drawdown from the highest cum so far (at least 0), its duration in rows and the date it starts from, and
    succdown, succ_duration, succ_start: the loss since the last rise. A loss from the very first row starts there. From a return below
    -1 on, which costs or short positions can give, cum and the losses are NaN, which is the highest and worst value of all."""
    over = W.partitionBy(pf).orderBy(date)
    run = over.rowsBetween(W.unboundedPreceding, 0)
    df = returns.withColumns({"cum": F.sum(_log_growth(ret)).over(run), "_t": F.row_number().over(over), "_begin": F.first(date).over(run)})
    df = df.withColumn("_peak", F.greatest(F.lit(0.0), F.max("cum").over(run)))
    # The scan carries the last peak's, and the last rise's, row number and date along.
    mark = F.struct(F.col("_t").alias("t"), F.col(date).alias("d"), F.col("cum").alias("c"))
    df = df.withColumns({"_top": F.last(F.when(F.col("cum") >= F.col("_peak"), mark), ignorenulls=True).over(run), "_up": F.last(F.when(F.col(ret) > 0, mark), ignorenulls=True).over(run)})
    df = df.withColumns({
        "drawdown": 1 - F.exp(F.col("cum") - F.col("_peak")), "duration": F.col("_t") - F.coalesce("_top.t", F.lit(0)), "start": F.coalesce("_top.d", "_begin"),
        "succdown": F.greatest(F.lit(0.0), 1 - F.exp(F.col("cum") - F.coalesce("_up.c", F.lit(0.0)))), "succ_duration": F.col("_t") - F.coalesce("_up.t", F.lit(0)), "succ_start": F.coalesce("_up.d", "_begin"),
    })
    return df.drop("_t", "_peak", "_top", "_up", "_begin")


def _sharpe(mean: Column, std: Column, per_year: int) -> Column:
    return F.when(std == 0, 0.0).otherwise(div(mean, std) * F.sqrt(F.lit(float(per_year))))


def _worst(date: str) -> dict[str, Column]:
    """Aggregates of drawdowns() rows: the worst loss, of several the earliest, as structs of its size, dates and duration."""
    early = -F.unix_date(F.col(date).cast("date"))
    return {k: F.max(F.struct(F.col(v), early.alias("e"), F.col(s).alias("start"), F.col(date).alias("end"), F.col(n).alias("duration"))) for k, v, s, n in (("mdd", "drawdown", "start", "duration"), ("msd", "succdown", "succ_start", "succ_duration"))}


def _named_worst() -> list[Column]:
    of = lambda k, v: [F.col(f"_{k}.{v}").alias(k), *(F.col(f"_{k}.{x}").alias(f"{k}_{x}") for x in ("start", "end", "duration"))]
    return [*of("mdd", "drawdown"), *of("msd", "succdown")]


def evaluate(returns: DataFrame, ret: str = "net_ret", excess: str = "net_excess", pf: str = "pf", date: str = "date", per_year: int = 12, log: bool = True, kind: str | None = None) -> DataFrame:
    """One row per portfolio, after costs unless ret and excess are others, or kind is one of RETURN_TYPES: means and population
    deviations of excess returns, Sharpe ratio (0 without deviation), cumulative return, worst drawdown and successive loss with the
    dates that they start from and end at and their durations in rows, turnover, numbers held.
    Mean, deviation, Sharpe ratio and turnover are those of a year of `per_year` periods."""
    ret, excess = RETURN_TYPES[kind] if kind else (ret, excess)
    d = drawdowns(returns, ret, pf, date)
    end = F.max_by("cum", date)
    m, s = F.avg(excess), F.stddev_pop(excess)
    out = d.groupBy(pf).agg(
        F.count("*").alias("periods"), (m * per_year).alias("mean"), (s * F.sqrt(F.lit(float(per_year)))).alias("std"),
        _sharpe(m, s, per_year).alias("sharpe"), (end if log else F.expm1(end)).alias("cum_ret"), *(c.alias(f"_{k}") for k, c in _worst(date).items()),
        (F.avg("turnover") * per_year).alias("turnover"), F.avg("n_long").alias("n_long"), F.avg("n_short").alias("n_short"))
    return out.select(pf, "periods", "mean", "std", "sharpe", "cum_ret", *_named_worst(), "turnover", "n_long", "n_short")


def evaluate_series(returns: DataFrame, ret: str = "net_ret", excess: str = "net_excess", pf: str = "pf", date: str = "date", per_year: int = 12, log: bool = True, kind: str | None = None) -> DataFrame:
    """What evaluate() gives, up to each date."""
    ret, excess = RETURN_TYPES[kind] if kind else (ret, excess)
    run = W.partitionBy(pf).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    d = drawdowns(returns, ret, pf, date)
    m, s = F.avg(excess).over(run), F.stddev_pop(excess).over(run)
    out = d.select(
        pf, date, F.count("*").over(run).alias("periods"), (m * per_year).alias("mean"), (s * F.sqrt(F.lit(float(per_year)))).alias("std"), _sharpe(m, s, per_year).alias("sharpe"), (F.col("cum") if log else F.expm1("cum")).alias("cum_ret"),
        *(c.over(run).alias(f"_{k}") for k, c in _worst(date).items()), (F.avg("turnover").over(run) * per_year).alias("turnover"),
        F.avg("n_long").over(run).alias("n_long"), F.avg("n_short").over(run).alias("n_short"))
    return out.select(pf, date, "periods", "mean", "std", "sharpe", "cum_ret", *_named_worst(), "turnover", "n_long", "n_short")
