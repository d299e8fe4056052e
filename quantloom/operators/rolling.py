"""Moving windows by running sums, and regressions over them.

A window's sum is a running sum at its end less the one before its start: one scan of an id's rows serves windows of any number and
length, where a frame of n rows would be added up anew for each row. Values are taken from their id's mean first, so that little is lost
in the difference. Regressions need only sums of cross products; Spark makes them, and a batch of windows is solved at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import _RN, Panel

#: A window's variance below this part of the running sum of squares counts as none.
_FLAT = 1e-12
#: Correlation matrices with a smaller least eigenvalue count as singular.
_SINGULAR = 1e-11


def running(df: DataFrame, terms: dict[str, Column], by: list[str | Column], order: str) -> DataFrame:
    """df with a running sum, over rows by `order`, of each term; nulls count as nothing."""
    run = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({k: F.sum(F.coalesce(v, F.lit(0))).over(run) for k, v in terms.items()})


def window_sum(name: str, n: int, by: list[str | Column], order: str) -> Column:
    """From a running sum `name`: the sum over the last n rows."""
    return F.col(name) - F.coalesce(F.lag(name, n).over(W.partitionBy(*by).orderBy(order)), F.lit(0))


def _products(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def moments(df: DataFrame, by: list[str | Column], order: str, columns: list[str], n: int, prefix: str, centred: bool = True) -> DataFrame:
    """df with the sums that solve() takes, over the last n rows, of those rows in which no column is null.

    columns: the dependent variable first. centred: values are less their id's mean; not for regressions without a constant.
    """
    every = W.partitionBy(*by)
    full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    k = len(columns)
    mean = lambda c: F.coalesce(F.avg(F.when(full, F.col(c).cast("double"))).over(every), F.lit(0.0)) if centred else F.lit(0.0)
    df = df.withColumns({f"{prefix}o{i}": mean(c) for i, c in enumerate(columns)})
    df = df.withColumns({f"{prefix}v{i}": F.when(full, F.col(c).cast("double") - F.col(f"{prefix}o{i}")) for i, c in enumerate(columns)})
    v = [F.col(f"{prefix}v{i}") for i in range(k)]
    terms = {f"{prefix}n": full.cast("long"), **{f"{prefix}s{i}": v[i] for i in range(k)}, **{f"{prefix}p{i}_{j}": v[i] * v[j] for i, j in _products(k)}}
    df = running(df, terms, by, order)
    sums = {c: window_sum(c, n, by, order) for c in terms}
    scale = {f"{prefix}t{i}": F.col(f"{prefix}p{i}_{i}") for i in range(k)}
    return df.withColumns(scale).withColumns(sums).drop(*(f"{prefix}v{i}" for i in range(k)))


def moment_columns(k: int, prefix: str) -> list[str]:
    return [f"{prefix}n", *(f"{prefix}{x}{i}" for x in "ost" for i in range(k)), *(f"{prefix}p{i}_{j}" for i, j in _products(k))]


def solve(pdf: pd.DataFrame, k: int, prefix: str, least: int, constant: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (the constant first), r2 and deviation of the residuals of the regressions whose sums are rows of pdf; NaN where
    there are fewer than `least` rows, or not enough, or the matrix is singular."""
    get = lambda c: pdf[f"{prefix}{c}"].to_numpy(float)
    rows, m = len(pdf), k - 1
    n = get("n")
    s, o, t = (np.stack([get(f"{x}{i}") for i in range(k)], 1) for x in "sot")
    p = np.empty((rows, k, k))
    for i, j in _products(k):
        p[:, i, j] = p[:, j, i] = get(f"p{i}_{j}")
    some = np.where(n > 0, n, 1.0)
    central = p - s[:, :, None] * s[:, None, :] / some[:, None, None]
    used = central if constant else p
    size = np.einsum("rii->ri", used)[:, 1:]
    good = (n >= max(least, m + constant)) & (size > _FLAT * np.maximum(t[:, 1:], 1e-300)).all(1)
    b, r2, ivol = np.full((rows, m), np.nan), np.full(rows, np.nan), np.full(rows, np.nan)
    at = np.flatnonzero(good)
    d = np.sqrt(size[at])
    r = used[at, 1:, 1:] / (d[:, :, None] * d[:, None, :])
    fine = np.linalg.eigvalsh(r)[:, 0] > _SINGULAR if len(at) else np.zeros(0, bool)
    at, d, r = at[fine], d[fine], r[fine]
    if len(at):
        x = np.linalg.solve(r, (used[at, 1:, 0] / d)[:, :, None])[:, :, 0] / d
        b[at] = x
        rest = used[at, 0, 0] - (x * used[at, 1:, 0]).sum(1)
        total = central[at, 0, 0]
        some_total = total > _FLAT * np.maximum(t[at, 0], 1e-300)
        r2[at] = np.where(some_total, 1 - rest / np.where(some_total, total, 1), np.nan)
        mean = 0.0 if constant else (s[at, 0] - (x * s[at, 1:]).sum(1)) / n[at]
        more = n[at] > 1
        ivol[at] = np.where(more, np.sqrt(np.maximum(rest - n[at] * mean**2, 0) / np.where(more, n[at] - 1, 1)), np.nan)
    if constant:
        mean = o + s / some[:, None]
        b = np.column_stack([mean[:, 0] - (b * mean[:, 1:]).sum(1), b])
    return b, r2, ivol


def rolling_regression(p: Panel, y: str, xs: list[str], n: int, min_n: int | None = None, constant: bool = True) -> DataFrame:
    """id, date, const, b_<x>, r2, ivol of least squares of y on xs over the last n periods; null with fewer than min_n (default: n) rows
    that have all values, or where the regressors are collinear. ivol: sample deviation of the residuals; r2 is about y's mean."""
    p = p if p.m == 1 else p.numbered()
    by = [p.id] if p.m == 1 else [p.id, F.col(_RN) % p.m]
    k, prefix = 1 + len(xs), "_m"
    sums = moments(p.df.select(p.id, p.date, y, *xs, *([_RN] if p.m > 1 else [])), by, p.date, [y, *xs], n, prefix, constant).select(p.id, p.date, *moment_columns(k, prefix))
    keys, least = [p.id, p.date], min_n or n
    names = [*(["const"] if constant else []), *(f"b_{x}" for x in xs), "r2", "ivol"]

    def run(batches):
        for pdf in batches:
            b, r2, ivol = solve(pdf, k, prefix, least, constant)
            out = pdf[keys].copy()
            for name, v in zip(names, [*b.T, r2, ivol]):
                out[name] = v
            yield out

    kinds = dict(p.df.dtypes)
    out = sums.mapInPandas(run, ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"`{c}` double" for c in names]))
    return out.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in names})
