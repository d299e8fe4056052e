"""Joins: merge with a policy for clashing columns, as-of and interval links, primary security, outer fill, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.selection import exact_quantiles


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", drop: str | None = None, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on equal, not null keys. drop: 'right' or 'left', the side that loses columns both have; None: both stay, with suffixes."""
    clash = [c for c in left.columns if c in right.columns and c not in on]
    if drop == "right":
        right = right.drop(*clash)
    elif drop == "left":
        left = left.drop(*clash)
    else:
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(right, on, how)


def asof(left: DataFrame, right: DataFrame, by: str, at: str, start: str, end: str | None = None, values: list[str] = []) -> DataFrame:  # noqa: B006
    """left with the values of the latest right row of the key that starts no later; null if that row has ended. An open end is null.

    One shuffle by key and one pass in order of time over both sides together; nothing is multiplied.
    """
    keep = list(left.columns)
    fields = [c for c in [start, end] if c] + [c for c in values if c not in (start, end)]
    a = left.select(by, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.struct(*keep).alias("_row"))
    b = right.select(by, F.col(start).alias("_t"), F.lit(0).alias("_k"), F.struct(*fields).alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where("_k = 1")
    if end:
        found = found.withColumn("_hit", F.when(F.col(f"_hit.{end}").isNull() | (F.col("_t") <= F.col(f"_hit.{end}")), F.col("_hit")))
    return found.select("_row.*", *(F.col(f"_hit.{c}").alias(c) for c in values))


def interval(left: DataFrame, right: DataFrame, by: str, at: str, start: str, end: str, how: str = "left") -> DataFrame:
    """Rows of the key whose interval, ends included, holds left's date; an open end is null. right's key and ends go."""
    r = right.withColumnsRenamed({by: "_by", start: "_s", end: "_e"})
    on = (F.col(by) == F.col("_by")) & (F.col(at) >= F.col("_s")) & (F.col("_e").isNull() | (F.col(at) <= F.col("_e")))
    return left.join(r, on, how).drop("_by", "_s", "_e")


def primary(df: DataFrame, date: str, firm: str, group: str, linked: str, volume: str, out: str = "primary") -> DataFrame:
    """out: whether a security is its firm's primary one at a date. In three steps: linked as such, or the firm's only one; where a
    firm has none, that with the most volume; among securities without a firm the same by `group`."""
    by_firm, by_group = W.partitionBy(date, firm), W.partitionBy(date, group)
    has, yes = F.col(firm).isNotNull(), F.col(out).cast("int")
    df = df.withColumn(out, F.coalesce(F.col(linked), F.lit(False)) | (has & (F.count("*").over(by_firm) == 1)))
    most = lambda w: (F.sum(yes).over(w) == 0) & F.coalesce(F.col(volume) == F.max(volume).over(w), F.lit(False))
    df = df.withColumn(out, F.col(out) | (has & most(by_firm)))
    return df.withColumn(out, F.col(out) | (~has & most(by_group)))


def fill_outer(a: DataFrame, q: DataFrame, on: list[str], age: str, suffix: str = "_q") -> DataFrame:
    """Full outer join of annual with quarterly values: a value is q's where a's row is missing or older (by `age`), or a's value is, and q has one."""
    both = [c for c in a.columns if c in q.columns and c not in on]
    j = a.withColumn("_a", F.lit(1)).join(q.withColumnsRenamed({c: c + suffix for c in both}), on, "full")
    newer = F.col("_a").isNull() | F.coalesce(F.col(age) < F.col(age + suffix), F.lit(False))
    pick = {c: F.when((newer | F.col(c).isNull()) & F.col(c + suffix).isNotNull(), F.col(c + suffix)).otherwise(F.col(c)) for c in both}
    return j.withColumns(pick).drop("_a", *(c + suffix for c in both))


def remove_duplicates(df: DataFrame, key: list[str], fiscal_year: str, fiscal_quarter: str) -> DataFrame:
    """Of rows alike in key: the last fiscal year's, then the first quarter's; rows without a quarter go, ties stay."""
    df = df.where(F.col(fiscal_quarter).isNotNull())
    df = df.withColumn("_y", F.max(fiscal_year).over(W.partitionBy(*key))).where(F.col("_y").eqNullSafe(F.col(fiscal_year)))
    return df.withColumn("_q", F.min(fiscal_quarter).over(W.partitionBy(*key))).where(F.col("_q") == F.col(fiscal_quarter)).drop("_y", "_q")


def quarterise(df: DataFrame, id: str, date: str, quarter: str, ytd: str, out: str, m: int = 1) -> DataFrame:
    """Quarterly values from year-to-date ones: fills `out`, or creates it."""
    before = F.lag(ytd, m).over(W.partitionBy(id).orderBy(date))
    flow = F.when(F.col(quarter) == 1, F.col(ytd)).otherwise(F.col(ytd) - before)
    return df.withColumn(out, F.coalesce(F.col(out), flow) if out in df.columns else flow)


def to_usd(df: DataFrame, rates: DataFrame, date: str, currency: str, columns: list[str]) -> DataFrame:
    """rates: date, tocurd, exratd per pound. Amounts in other currencies times dollars per unit; rates are few rows and small."""
    usd = rates.where("tocurd = 'USD'").select(F.col("datadate").alias("_d"), F.col("exratd").alias("_usd"))
    per = rates.join(usd, F.col("datadate") == F.col("_d")).select("_d", F.col("tocurd").alias("_cur"), F.try_divide("_usd", "exratd").alias("_rate"))
    j = df.join(per, (F.col(date) == F.col("_d")) & (F.col(currency) == F.col("_cur")), "left")
    return j.withColumns({c: F.when(F.col(currency) != "USD", F.col(c) * F.col("_rate")).otherwise(F.col(c)) for c in columns}).drop("_d", "_cur", "_rate")


def carried(df: DataFrame, id: str, date: str, columns: list[str]) -> DataFrame:
    """df with an id's last known values where there are none."""
    run = W.partitionBy(id).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in columns})


def delisting_returns(stocks: DataFrame, events: DataFrame, id: str, date: str, method: int = 1, codes: tuple[str, ...] = ()) -> DataFrame:
    """Returns that include delisting returns, and cash dividends. stocks: ret; events: dlret, dlstcd, exchcd, distcd, divamt, dates as in stocks.

    codes: columns of share and exchange codes, which are often missing from a delisting on: in stocks the last known one counts, and
    an event without an exchange code has that which the stock had last.

    A missing delisting return of code 500 or 520 to 584 is, by method 1, -0.30; by method 2 -0.35 on exchanges 1 and 2 and -0.55 on 3.
    Distributions are cash if the hundreds digit of their code is 2 or 3; a date with others only has 0.
    """
    if codes:
        stocks = carried(stocks, id, date, list(codes))
    if "exchcd" in codes:
        known = stocks.where(F.col("exchcd").isNotNull()).select(id, F.col(date).alias("_since"), F.col("exchcd").alias("_exchcd"))
        events = asof(events, known, id, date, "_since", values=["_exchcd"]).withColumn("exchcd", F.coalesce("exchcd", "_exchcd")).drop("_exchcd")
    code = F.col("dlstcd")
    bad = (code == 500) | code.between(520, 584)
    fill = F.lit(-0.30) if method == 1 else F.when(F.col("exchcd").isin(1, 2), -0.35).when(F.col("exchcd") == 3, -0.55)
    filled = F.coalesce(F.col("dlret"), F.when(bad, fill)) if method else F.col("dlret")
    delisted = events.where(code.isNotNull()).select(id, date, filled.alias("dlret")).groupBy(id, date).agg(F.max("dlret").alias("dlret"))
    kind = F.floor(F.col("distcd") / 100) % 10
    paid = events.where(F.col("distcd").isNotNull()).select(id, date, "distcd", "divamt").distinct()
    cash = paid.groupBy(id, date).agg(F.coalesce(F.sum(F.when(kind.isin(2, 3), F.col("divamt"))), F.lit(0.0)).alias("cash_div"))
    out = stocks.join(delisted, [id, date], "left").join(cash, [id, date], "left")
    both = (1 + F.coalesce("ret", F.lit(0.0))) * (1 + F.coalesce("dlret", F.lit(0.0))) - 1
    return out.withColumn("ret", F.when(F.coalesce("ret", "dlret").isNotNull(), both))


_PERCENTILES = ((0.001, "p0_1"), (0.01, "p1"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.99, "p99"), (0.999, "p99_9"))


def compare(a: DataFrame, b: DataFrame, on: list[str], tolerance: float = 0.01) -> DataFrame:
    """Per common column: share that matches (within a relative tolerance, or both about zero), correlation, nulls on either side."""
    names = [c for c, t in a.dtypes if c in b.columns and c not in on and t != "string"]
    j = a.join(b.withColumnsRenamed({c: c + "_y" for c in names}), on)
    parts = []
    for c in names:
        x, y = F.col(c).cast("double"), F.col(c + "_y").cast("double")
        both = x.isNotNull() & y.isNotNull()
        match = (F.abs(x - y) <= tolerance * F.abs(y)) | ((F.abs(x) < 1e-5) & (F.abs(y) < 1e-5))
        parts.append(F.struct(F.lit(c).alias("column"), F.avg(F.when(both, match.cast("double"))).alias("match"), F.corr(x, y).alias("corr"), F.count_if(x.isNull()).alias("null_x"), F.count_if(y.isNull()).alias("null_y")))
    return j.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def inspect(df: DataFrame, date: str, id: str) -> DataFrame:
    """Per numeric column: rows, nulls, infinities, mean, deviation, least, percentiles, largest; with the numbers of dates and ids.
    Nulls and infinities don't count in the others."""
    names = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in (date, id)]
    x = {c: F.col(c).cast("double") for c in names}
    endless = {c: F.abs(v) == float("inf") for c, v in x.items()}
    finite = {c: F.when(~endless[c] & ~F.isnan(v), v) for c, v in x.items()}
    cuts = exact_quantiles(df, {c: (finite[c], [q for q, _ in _PERCENTILES]) for c in names})
    parts = [
        F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(endless[c]).alias("infs"), F.avg(finite[c]).alias("mean"), F.stddev_samp(finite[c]).alias("std"), F.min(finite[c]).alias("min"), *(F.lit(v).cast("double").alias(k) for v, (_, k) in zip(cuts[c], _PERCENTILES)), F.max(finite[c]).alias("max"), F.count_distinct(date).alias("dates"), F.count_distinct(id).alias("ids"))
        for c in names
    ]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def ids_by_date(df: DataFrame, date: str) -> DataFrame:
    """date, n: the rows of each date, which in a panel are its ids."""
    return df.groupBy(date).agg(F.count("*").alias("n"))
