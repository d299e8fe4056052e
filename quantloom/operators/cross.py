"""Cross-sectional operators: within a group, usually a date.

Quantiles are exact, with linear interpolation. Breakpoints are aggregates of one row per group, computed for several columns in one
pass, and joined back; the join is a broadcast where Spark finds the breakpoints small. Without a group they are those of the whole
table: selection of ranks finds them at once, as numbers, and no task ever holds the column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import clamp, col, div
from quantloom.operators.selection import exact_quantiles


def quantile(c: str | Column, q: float) -> Column:
    return F.percentile(col(c).cast("double"), F.lit(q))


def levels(split: int | list[float]) -> list[float]:
    """Inner quantile levels: of equal classes for an int; a list as it is, without a last level of 1 or more."""
    if isinstance(split, int):
        return [i / split for i in range(1, split)]
    return list(split[:-1] if split and split[-1] >= 1 else split)


def breakpoints(df: DataFrame, group: list[str], of: dict[str, tuple[str | Column, list[float]]]) -> DataFrame:
    """One row per group; of: prefix -> (column, levels) gives columns prefix_0, prefix_1, ..."""
    return df.groupBy(*group).agg(*(quantile(c, q).alias(f"{k}_{i}") for k, (c, qs) in of.items() for i, q in enumerate(qs)))


def with_breakpoints(df: DataFrame, group: list[str], of: dict[str, tuple[str | Column, list[float]]]) -> DataFrame:
    """df with the columns that breakpoints() has."""
    if group:
        return df.join(breakpoints(df, group, of), group, "left")
    return df.withColumns({f"{k}_{i}": F.lit(x).cast("double") for k, xs in exact_quantiles(df, of).items() for i, x in enumerate(xs)})


def classify(df: DataFrame, column: str, split: int | list[float], out: str, group: list[str], by: Column | None = None, ascending: bool = True) -> DataFrame:
    """Class 0, 1, ... by quantile, intervals closed on the right. `by`: values that give the cuts, e.g. those of one exchange; none of them: null."""
    qs = levels(split)
    above = reduce(lambda a, b: a + b, ((F.col(column) > F.col(f"_q_{i}")).cast("int") for i in range(len(qs))), F.lit(0))
    cls = above if ascending else len(qs) - above
    known = F.col(column).isNotNull() & (F.col("_q_0").isNotNull() if qs else F.lit(True))
    wide = with_breakpoints(df, group, {"_q": (by if by is not None else column, qs)})
    return wide.withColumn(out, F.when(known, cls)).drop(*(f"_q_{i}" for i in range(len(qs))))


def _limits(df: DataFrame, column: str, limits: tuple, group: list[str], by: Column | None) -> tuple[DataFrame, Column, Column]:
    lo, hi = limits
    of = {k: (by if by is not None else column, [q]) for k, q in (("_lo", lo), ("_hi", None if hi is None else 1 - hi)) if q is not None}
    at = lambda k: F.col(f"{k}_0") if k in of else F.lit(None).cast("double")
    return with_breakpoints(df, group, of), at("_lo"), at("_hi")


def trim(df: DataFrame, column: str, limits: tuple, out: str, group: list[str], by: Column | None = None) -> DataFrame:
    """out: whether the value lies within the quantiles; limits are the tails' sizes, None for none. False for null."""
    wide, lo, hi = _limits(df, column, limits, group, by)
    x = F.col(column)
    inside = x.isNotNull()
    if limits[0] is not None:
        inside &= x >= lo
    if limits[1] is not None:
        inside &= x <= hi
    return wide.withColumn(out, F.coalesce(inside, F.lit(False))).drop("_lo_0", "_hi_0")


def filter_quantile(df: DataFrame, column: str, limits: tuple, group: list[str], by: Column | None = None) -> DataFrame:
    return trim(df, column, limits, "_keep", group, by).where("_keep").drop("_keep")


def winsorize(df: DataFrame, column: str, limits: tuple, out: str, group: list[str], by: Column | None = None) -> DataFrame:
    """Values beyond the quantiles become the nearest value there is within them."""
    wide, lo, hi = _limits(df, column, limits, group, by)
    x = by if by is not None else F.col(column)
    inner = {"_least": F.min(F.when(x >= lo, x)), "_most": F.max(F.when(x <= hi, x))}
    if group:
        done = df.join(wide.groupBy(*group).agg(*(v.alias(k) for k, v in inner.items())), group, "left")
    else:
        ends = wide.agg(*(v.alias(k) for k, v in inner.items())).first()
        done = df.withColumns({k: F.lit(ends[k]) for k in inner})
    return done.withColumn(out, clamp(column, F.col("_least"), F.col("_most"))).drop("_least", "_most")


def rank(c: str | Column, group: list[str | Column], ascending: bool = True, pct: bool = False) -> Column:
    """Average rank of ties among values that aren't null; pct: over their number."""
    c = col(c)
    order = W.partitionBy(*group).orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    r = F.rank().over(order) + (F.count("*").over(W.partitionBy(*group, c)) - 1) / 2
    r = F.when(c.isNotNull(), r)
    return r / F.count(c).over(W.partitionBy(*group)) if pct else r


def zscore(c: str | Column, group: list[str]) -> Column:
    w = W.partitionBy(*group)
    return div(col(c) - F.avg(col(c)).over(w), F.stddev_samp(col(c)).over(w))


def zrank(df: DataFrame, columns: list[str], out: str, group: list[str], digits: int = 9) -> DataFrame:
    """z-score of the rank of the mean of the z-scores of ranks; of those columns that aren't null. Means that are alike to `digits`
    decimals are ties, in whatever order they were summed."""
    from quantloom.functions.columns import mean_present

    df = df.withColumns({f"_r_{c}": rank(c, group) for c in columns})
    df = df.withColumns({f"_z_{c}": zscore(f"_r_{c}", group) for c in columns})
    df = df.withColumn("_mean", mean_present(*(f"_z_{c}" for c in columns)))
    df = df.withColumn("_rank", rank(F.round("_mean", digits), group))
    return df.withColumn(out, zscore("_rank", group)).drop("_mean", "_rank", *(f"_{k}_{c}" for k in "rz" for c in columns))


def anomalies(df: DataFrame, column: str, id: str, date: str, out: str, kinds: tuple[str, ...] = ("change",), tails: tuple[float, float] = (0.05, 0.95), multiples: tuple[float, float] = (1.0, 1.0), rare_negative: float = 0.0005) -> DataFrame:
    """out: whether a value is odd by one of the kinds; bounds are over the whole panel.

    change: its percentage changes from the value before and from the next one back both lie beyond the quantiles by a multiple of
    their distance from the median. value: the value itself does. negative: it is negative where few are, a part below `rare_negative`.
    """
    w, x = W.partitionBy(id).orderBy(date), F.col(column).cast("double")
    wide = df.withColumns({"_before": div(x, F.lag(x).over(w)) - 1, "_after": div(x, F.lead(x).over(w)) - 1, "_value": x})
    names = [c for kind, cs in (("change", ["_before", "_after"]), ("value", ["_value"])) if kind in kinds for c in cs]
    bounds = exact_quantiles(wide, {c: (c, [tails[0], 0.5, tails[1]]) for c in names}) if names else {}
    negative = wide.agg(div(F.count_if(F.col("_value") < 0), F.count("_value"))).first()[0] if "negative" in kinds else None

    def beyond(c: str) -> Column:
        v, (low, mid, high) = F.col(c), (F.lit(x).cast("double") for x in bounds[c])
        return F.coalesce((v < low - multiples[0] * (mid - low)) | (v > high + multiples[1] * (high - mid)), F.lit(False))

    odd = F.lit(False)
    if "change" in kinds:
        odd = odd | (beyond("_before") & beyond("_after"))
    if "value" in kinds:
        odd = odd | beyond("_value")
    if "negative" in kinds:
        odd = odd | F.coalesce((F.col("_value") < 0) & F.lit(negative is not None and negative < rare_negative), F.lit(False))
    return wide.withColumn(out, odd).select(*df.columns, out)
