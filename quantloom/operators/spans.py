"""Spans of dates: histories of identifiers as spans that don't overlap, spans that two tables share, and the links that come of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import delisting_returns, interval, primary

_OPEN = "9999-12-31"


def merged(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """keys, start, end: the spans of equal keys that overlap, or follow each other within `gap` days, as one. A null end is open.

    Gaps and islands: in order of their starts, a span opens a new island if all spans before it have ended.
    """
    last = F.coalesce(F.col(end), F.lit(_OPEN).cast("date"))
    by = W.partitionBy(*keys).orderBy(start, "_last")
    rows = df.select(*keys, F.col(start).cast("date").alias(start), last.cast("date").alias("_last")).where(F.col(start) <= F.col("_last"))
    rows = rows.withColumn("_reach", F.max("_last").over(by.rowsBetween(W.unboundedPreceding, -1)))
    opens = F.col("_reach").isNull() | (F.datediff(start, "_reach") > gap)
    rows = rows.withColumn("_island", F.sum(opens.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max("_last").alias("_last"))
    return out.select(*keys, start, F.when(F.col("_last") < F.lit(_OPEN).cast("date"), F.col("_last")).alias(end))


def history(df: DataFrame, id: str, value: str, date: str, start: str = "start", end: str = "end") -> DataFrame:
    """id, value, start, end: the runs of dates at which an id keeps a value. Rows without a value don't break a run; a value that
    comes back begins another."""
    by = W.partitionBy(id).orderBy(date)
    rows = df.select(id, value, date).where(F.col(value).isNotNull())
    changes = ~F.lag(value).over(by).eqNullSafe(F.col(value))
    rows = rows.withColumn("_run", F.sum(changes.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(id, "_run", value).agg(F.min(date).alias(start), F.max(date).alias(end)).drop("_run")


def shared(left: DataFrame, right: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """Rows of both with equal `on` whose spans have a date in common, with these dates. A null end is open. Other columns must differ."""
    r = right.withColumnsRenamed({start: "_s", end: "_e"})
    j = left.join(r, on)
    begin, stop = F.greatest(start, "_s"), F.least(end, "_e")  # least() takes no notice of an open end
    j = j.withColumns({"_begin": begin, "_stop": stop}).where(F.col("_stop").isNull() | (F.col("_begin") <= F.col("_stop")))
    return j.drop("_s", "_e").withColumns({start: F.col("_begin"), end: F.col("_stop")}).drop("_begin", "_stop")


def issuer_cusip(c: str | Column) -> Column:
    """A cusip without its check digit."""
    return F.substring(F.col(c) if isinstance(c, str) else c, 1, 8)


def cusip_linktable(stocks: DataFrame, securities: DataFrame, accounts: DataFrame | None = None, id: str = "permno", firm: str = "gvkey", by_history: bool = False, span: tuple[str, str] | None = None) -> DataFrame:
    """cusip, firm, id, linkdt, linkenddt, linkprim: stocks and securities that have a cusip, of eight characters, in common.

    stocks: id, cusip, date; securities: cusip, firm, and, if they hold for some time only, the columns `span` of its first and last
    date (null: open). A stock's first cusip stands for all its dates, or, by_history, each of its cusips for the dates that it has it.
    linkprim: whether a cusip is one of `accounts`, which has a column of them.
    """
    own = stocks.select(id, issuer_cusip("cusip").alias("cusip"), F.col("date").cast("date").alias("date"))
    if by_history:
        own = history(own, id, "cusip", "date", "linkdt", "linkenddt")
    else:
        own = own.groupBy(id).agg(F.min_by("cusip", F.when(F.col("cusip").isNotNull(), F.col("date"))).alias("cusip"), F.min("date").alias("linkdt"), F.max("date").alias("linkenddt"))
    other = securities.select(issuer_cusip("cusip").alias("cusip"), firm, *(F.col(c).cast("date").alias(n) for c, n in zip(span or (), ("linkdt", "linkenddt")))).where(F.col("cusip").isNotNull())
    links = shared(own, merged(other, ["cusip", firm], "linkdt", "linkenddt"), ["cusip"], "linkdt", "linkenddt") if span else own.join(other.distinct(), "cusip")
    if accounts is None:
        return links.select("cusip", firm, id, "linkdt", "linkenddt", F.lit(False).alias("linkprim"))
    seen = accounts.select(issuer_cusip("cusip").alias("cusip")).where(F.col("cusip").isNotNull()).distinct().withColumn("_seen", F.lit(True))
    return links.join(seen, "cusip", "left").select("cusip", firm, id, "linkdt", "linkenddt", F.coalesce("_seen", F.lit(False)).alias("linkprim"))


def linked_stocks(stocks: DataFrame, links: DataFrame, id: str = "permno", firm: str = "gvkey", group: str = "permco", date: str = "date", price: str = "prc", volume: str = "vol") -> DataFrame:
    """stocks with their firm at each date, by a link table (id, firm, linkdt, linkenddt, linkprim), and whether they are its primary stock.
    Of several firms at a date the first by name counts."""
    found = interval(stocks.select(id, date), links.select(id, firm, "linkdt", "linkenddt", "linkprim"), id, date, "linkdt", "linkenddt", "inner")
    found = found.groupBy(id, date).agg(F.min(F.struct(firm, (~F.col("linkprim")).alias("_not"))).alias("_l")).select(id, date, F.col(f"_l.{firm}").alias(firm), (~F.col("_l._not")).alias("_linked"))
    wide = stocks.join(found, [id, date], "left").withColumn("_dollars", F.abs(F.col(price)) * F.col(volume))
    return primary(wide, date, firm, group, "_linked", "_dollars").drop("_linked", "_dollars")


def prepared_stocks(stocks: DataFrame, events: DataFrame, links: DataFrame, id: str = "permno", date: str = "date", method: int = 1, codes: tuple[str, ...] = ("shrcd", "exchcd"), **names: str) -> DataFrame:
    """Stocks as the characteristics take them: returns with delisting returns and cash dividends, codes carried, firm and primary stock."""
    return linked_stocks(delisting_returns(stocks, events, id, date, method, codes), links, id, date=date, **names)
