"""Steps that join a stock or accounting panel to other tables: factors, risk-free rate, market equity; and share codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.panel import to_month_end

#: Share codes of ordinary common shares.
ORDINARY = (10, 11, 12)


def ordinary_shares(df: DataFrame, code: str = "shrcd") -> DataFrame:
    """Rows of ordinary common shares; a null code isn't one. Exchanges aren't looked at: they may change in the month of delisting."""
    return df.where(F.col(code).isin(*ORDINARY))


def risk_free_rate(df: DataFrame, date: str, rate: str, start: str | None = None, end: str | None = None, month_end: bool = False) -> DataFrame:
    """date, rf of a table of rates, from `start` to `end`, both included; dates at month ends, if wanted, before that."""
    at = to_month_end(date) if month_end else F.col(date)
    out = df.select(at.alias("date"), F.col(rate).alias("rf"))
    out = out.where(F.col("date") >= F.lit(start).cast("date")) if start else out
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def merge_with_factors(df: DataFrame, factors: DataFrame, names: dict[str, str], date: str = "date", only: list[str] | None = None, month_end: bool = True) -> DataFrame:
    """df with each date's factors. names: own name of a factor -> its column in `factors`; others keep theirs; rf stays df's own.

    only: own names of those wanted. A column that both have is the factors'. Rows of factors should have distinct dates.
    """
    f = factors.withColumnsRenamed({theirs: own for own, theirs in names.items() if theirs in factors.columns}).drop("rf")
    f = f.select(date, *(only if only is not None else [c for c in f.columns if c != date]))
    f = f.withColumn(date, to_month_end(date)) if month_end else f
    return df.drop(*(c for c in f.columns if c != date)).join(f, date, "left")


def add_market_equity(accounts: DataFrame, stocks: DataFrame, method: str = "latest", id: str = "gvkey", date: str = "date", datadate: str = "datadate", equity: str = "me_company", primary: str = "primary") -> DataFrame:
    """accounts with me, me_fiscal from the primary stocks' positive equity.

    latest: me of the row's date, and me_fiscal the me that the accounts have at datadate. year_end: both of the December of
    datadate's year. Of several stocks of an id at a date the largest counts.
    """
    me = stocks.where(F.col(primary) & (F.col(equity) > 0) & F.col(id).isNotNull())
    out = accounts.drop("me", "me_fiscal")
    if method == "latest":
        out = out.join(me.groupBy(id, date).agg(F.max(equity).alias("me")), [id, date], "left")
        fiscal = out.where("me is not null").groupBy(id, F.col(date).alias(datadate)).agg(F.max("me").alias("me_fiscal"))
        return out.join(fiscal, [id, datadate], "left")
    if method == "year_end":
        december = me.where(F.month(date) == 12).groupBy(id, F.year(date).alias("_year")).agg(F.max(equity).alias("me"))
        return out.withColumn("_year", F.year(datadate)).join(december, [id, "_year"], "left").withColumn("me_fiscal", F.col("me")).drop("_year")
    raise ValueError(f"method is latest or year_end, not {method}")


def without_raw(df: DataFrame, keys: list[str], made: list[str], but: tuple[str, ...] = ()) -> DataFrame:
    """Keys, made columns and those named in `but`, in df's order."""
    wanted = {*keys, *made, *but}
    return df.select(*(c for c in df.columns if c in wanted))


def year_to_date_columns(df: DataFrame) -> list[str]:
    """Columns of quarterly accounts that add up over the fiscal year: those named with a y at the end, but for the key."""
    return [c for c in df.columns if c.endswith("y") and c != "gvkey"]
