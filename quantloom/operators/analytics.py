"""Portfolio sorts, averages over time with t-statistics, Fama-MacBeth regressions, GRS test."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import col, div

_AGG = {"mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "median": F.median}


def weighted(c: str | Column, w: str | Column) -> Column:
    """Weighted mean (aggregate): a weight counts only where the value is there, and the other way round."""
    c, w = col(c), col(w)
    return div(F.sum(c * w), F.sum(F.when(c.isNotNull(), w)))


def weighted_mean(df: DataFrame, targets: list[str], weight: str | None, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(*((weighted(c, weight) if weight else F.avg(c)).alias(c) for c in targets))


def _aggregates(targets: list[str], weight: str | None, how: str | list[str]) -> list[Column]:
    if isinstance(how, str):
        return [(weighted(c, weight) if weight and how == "mean" else _AGG[how](c)).alias(c) for c in targets]
    return [(weighted(c, weight) if weight and h == "mean" else _AGG[h](c)).alias(f"{c}_{h}") for c in targets for h in how]


def append_long_short(df: DataFrame, date: str, cls: str, others: list[str] = [], label: int | None = None) -> DataFrame:  # noqa: B006
    """df and per date a class N: class 0 less class N-1, N-1 the largest class of all dates; none where a value is missing.

    `others` are further keys besides the date. The largest class is one row, from an aggregate.
    """
    values = [c for c in df.columns if c not in (date, cls, *others)]
    top = F.broadcast(df.agg(F.max(cls).alias("_top")))
    pick = lambda c, k: F.max(F.when(F.col(cls) == k, F.col(c)))
    ls = df.crossJoin(top).groupBy(date, *others, "_top").agg(*((pick(c, F.lit(0)) - pick(c, F.col("_top"))).alias(c) for c in values))
    ls = ls.withColumn(cls, F.col("_top") + 1 if label is None else F.lit(label)).na.drop(subset=values)
    return df.unionByName(ls.select(*df.columns))


def one_dim_sort(df: DataFrame, date: str, cls: str, targets: list[str], weight: str | None = None, how: str | list[str] = "mean", long_short: bool = True) -> DataFrame:
    """Aggregates by date and class; rows without a class don't count."""
    out = df.where(F.col(cls).isNotNull()).groupBy(date, cls).agg(*_aggregates(targets, weight, how))
    return append_long_short(out, date, cls) if long_short else out


def two_dim_sort(df: DataFrame, date: str, cls1: str, cls2: str, targets: list[str], weight: str | None = None, how: str = "mean", long_short: bool = True) -> DataFrame:
    """Aggregates by date and both classes; long-short along either class, and along both."""
    out = df.where(F.col(cls1).isNotNull() & F.col(cls2).isNotNull()).groupBy(date, cls1, cls2).agg(*_aggregates(targets, weight, how))
    if long_short:
        out = append_long_short(out, date, cls1, [cls2])
        out = append_long_short(out, date, cls2, [cls1])
    return out


def pivoted(df: DataFrame, date: str, cls1: str, cls2: str, target: str, classes: list[int]) -> DataFrame:
    """One row per date and first class, a column for each of the second, whose values are given."""
    return df.groupBy(date, cls1).pivot(cls2, classes).agg(F.first(target))


def relabel(df: DataFrame, cls: str, labels: list[str]) -> DataFrame:
    """Class numbers as labels; a class without one is null."""
    return df.withColumn(cls, F.get(F.array(*(F.lit(x) for x in labels)), F.col(cls).cast("int")))


def t_stat(df: DataFrame, date: str, columns: list[str], group: list[str] = [], lags: int | None = None) -> DataFrame:  # noqa: B006
    """Per column its mean and t-statistic, names c_mean and c_t, by group; with `lags`, Newey-West standard errors with Bartlett weights."""
    if lags is None:
        one = lambda c: div(F.avg(c), F.stddev_samp(c) / F.sqrt(F.count(c)))
        return df.groupBy(*group).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), one(c).alias(f"{c}_t"))))
    parts = []
    for c in columns:
        # Each column by itself: lags are between its own rows.
        x = df.where(F.col(c).isNotNull()).select(date, *group, F.col(c).cast("double").alias("x"))
        every, by_date = W.partitionBy(*group), W.partitionBy(*group).orderBy(date)
        x = x.withColumn("e", F.col("x") - F.avg("x").over(every))
        x = x.withColumns({f"p{k}": F.col("e") * F.lag("e", k).over(by_date) for k in range(1, lags + 1)})
        long_run = reduce(lambda a, b: a + b, (2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(1, lags + 1)), F.sum(F.col("e") * F.col("e")))
        parts.append(x.groupBy(*group).agg(F.avg("x").alias(f"{c}_mean"), div(F.avg("x"), F.sqrt(F.when(long_run > 0, long_run)) / F.count("x")).alias(f"{c}_t")))
    return reduce(lambda a, b: a.join(b, group, "full") if group else a.crossJoin(b), parts)


time_series_average = t_stat


def solve_normal(names: list[str]):
    """pandas function: rows with moments (n, y, yy, x*, xy*, xx**) to coefficients, for batches of groups at a time."""
    k = len(names)

    def solve(pdf):
        xx = np.stack([pdf[f"xx_{min(i, j)}_{max(i, j)}"].to_numpy() for i in range(k) for j in range(k)], 1).reshape(-1, k, k)
        xy = np.stack([pdf[f"xy_{i}"].to_numpy() for i in range(k)], 1)
        out = np.full((len(pdf), k), np.nan)
        good = np.linalg.matrix_rank(xx) == k if len(pdf) else np.zeros(0, bool)
        if good.any():
            out[good] = np.linalg.solve(xx[good], xy[good][:, :, None])[:, :, 0]
        return out

    return solve


def grouped_ols(df: DataFrame, group: list[str], y: str, xs: list[str], constant: bool = True, least: int | None = None) -> DataFrame:
    """Per group: n, coefficients b_<name> (b_const) and r2, of rows without nulls; groups with fewer than `least` rows (default: one
    more than coefficients) give none.

    Spark sums the cross products; a batch of groups is solved at a time.
    """
    names = [*(["const"] if constant else []), *xs]
    value = {**{x: F.col(x).cast("double") for x in xs}, "const": F.lit(1.0)}
    rows = df.select(*group, y, *xs).na.drop(subset=[y, *xs])
    terms = {f"xx_{i}_{j}": value[names[i]] * value[names[j]] for i in range(len(names)) for j in range(i, len(names))}
    terms |= {f"xy_{i}": value[n] * F.col(y) for i, n in enumerate(names)}
    sums = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"), *(F.sum(v).alias(k) for k, v in terms.items())).where(F.col("n") >= (least or len(names) + 1))
    solve = solve_normal(names)

    def run(batches):
        for pdf in batches:
            b = solve(pdf)
            xy = np.stack([pdf[f"xy_{i}"].to_numpy() for i in range(len(names))], 1)
            total = pdf["syy"] - (pdf["sy"] ** 2 / pdf["n"] if constant else 0)
            out = pdf[[*group, "n"]].copy()
            for i, name in enumerate(names):
                out[f"b_{name}"] = b[:, i]
            out["r2"] = 1 - (pdf["syy"] - (b * xy).sum(1)) / total.where(total > 0)
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "n long", *(f"`b_{n}` double" for n in names), "r2 double"])
    return sums.mapInPandas(run, schema)


def fama_macbeth(df: DataFrame, date: str, y: str, xs: list[str], lags: int | None = None) -> DataFrame:
    """Means and t-statistics of the coefficients of a regression per date."""
    if len(xs) == 1:  # slope and intercept are aggregates
        rows = df.where(F.col(y).isNotNull() & F.col(xs[0]).isNotNull())
        by = rows.groupBy(date).agg(F.count("*").alias("n"), F.regr_intercept(F.col(y), F.col(xs[0])).alias("b_const"), F.regr_slope(F.col(y), F.col(xs[0])).alias(f"b_{xs[0]}")).where("n > 2")
    else:
        by = grouped_ols(df, [date], y, xs)
    return t_stat(by, date, [f"b_{n}" for n in ("const", *xs)], lags=lags)


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(500):
        k = i // 2
        num = 1.0 if i == 0 else k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if i % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def cross_products(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of the products of all pairs of (1, *columns), over the rows without nulls, as a matrix. Each task sums its rows; the driver
    gets one number for each pair of columns."""
    k = 1 + len(columns)

    def run(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf.to_numpy(float)])
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(k * k), "s": total.ravel()})

    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).na.drop()
    out = np.zeros(k * k)
    for r in rows.mapInPandas(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out.reshape(k, k)


def grs_test(assets: DataFrame, factors: DataFrame, date: str) -> dict[str, float]:
    """GRS statistic and p-value of whether the factors explain all assets' mean returns, over the dates at which all are there.

    All comes from one matrix of cross products, so returns may be of any length, daily ones of many years too.
    """
    own, others = ([c for c in x.columns if c != date] for x in (assets, factors))
    clash = {c: f"{c}_f" for c in others if c in own}
    factors, others = factors.withColumnsRenamed(clash), [clash.get(c, c) for c in others]
    s = cross_products(assets.join(factors, date), [*others, *own])
    t, k, n = s[0, 0], len(others), len(own)
    if t - n - k <= 0:
        return {"grs": float("nan"), "p": float("nan")}
    xx, xr, rr = s[: 1 + k, : 1 + k], s[: 1 + k, 1 + k :], s[1 + k :, 1 + k :]
    b = np.linalg.solve(xx, xr)
    sigma = (rr - b.T @ xr) / (t - k - 1)
    mu = s[0, 1 : 1 + k] / t
    omega = (s[1 : 1 + k, 1 : 1 + k] - t * np.outer(mu, mu)) / (t - 1)
    stat = t / n * (t - n - k) / (t - k - 1) * (b[0] @ np.linalg.solve(sigma, b[0])) / (1 + mu @ np.linalg.solve(omega, mu))
    d1, d2 = n, t - n - k
    return {"grs": float(stat), "p": float(1 - _betainc(d1 / 2, d2 / 2, float(d1 * stat / (d1 * stat + d2))))}
