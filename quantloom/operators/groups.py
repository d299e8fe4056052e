"""User functions by group: by id, by date, by id and month, also over two tables.

A function gets a group's rows as a pandas frame, ordered, and gives a frame back: a row for each of its rows, or fewer. Spark
deals the groups; each must fit into a task, as an id's history, an id's month or a date's cross-section do. What sums, windows or
aggregates express belongs in those, which hold no group in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.panel import _RN, Panel

_KEY = "_group"


def apply_to_groups(df: DataFrame, by: list[str | Column], function: Callable[..., pd.DataFrame], schema: str, order: list[str], other: DataFrame | None = None, other_by: list[str | Column] | None = None) -> DataFrame:
    """function(rows) of each group of df, or function(rows, other's rows) where there is another table; schema: of what it gives.

    A group that only one of the tables has comes with no rows of the other. Nulls in `by` are a group. With an empty table there are no groups.
    """

    def grouped(t: DataFrame, keys: list[str | Column]):
        made = [(F.col(k) if isinstance(k, str) else k).alias(f"{_KEY}{i}") for i, k in enumerate(keys)]
        return t.select(*made, *(F.col(c).alias(c) for c in t.columns))  # new columns: both tables may come from one

    names = [f"{_KEY}{i}" for i in range(len(by))]

    def rows(x: pd.DataFrame) -> pd.DataFrame:
        known = [c for c in order if c in x.columns]
        return (x.sort_values(known, kind="stable") if known else x).drop(columns=names).reset_index(drop=True)

    left = grouped(df, by).groupBy(*names)
    if other is None:
        return left.applyInPandas(lambda x: function(rows(x)), schema)
    right = grouped(other, other_by or by).groupBy(*names)
    return left.cogroup(right).applyInPandas(lambda x, y: function(rows(x), rows(y)), schema)


def apply_to_ids(p: Panel, function: Callable[..., pd.DataFrame], schema: str, other: DataFrame | None = None) -> DataFrame:
    """By id; where m rows make a base period, by id and phase, so that rows of a group are a base period apart (not with another table)."""
    if p.m > 1 and other is None:
        p = p.numbered()
        return apply_to_groups(p.df, [p.id, F.col(_RN) % p.m], function, schema, [p.date])
    return apply_to_groups(p.df, [p.id], function, schema, [p.date], other)


def apply_to_dates(p: Panel, function: Callable[..., pd.DataFrame], schema: str, other: DataFrame | None = None) -> DataFrame:
    return apply_to_groups(p.df, [p.date], function, schema, [p.id], other)


def apply_to_id_months(p: Panel, function: Callable[..., pd.DataFrame], schema: str, other: DataFrame | None = None) -> DataFrame:
    """By id and calendar month, for daily rows."""
    return apply_to_groups(p.df, [p.id, F.trunc(p.date, "month")], function, schema, [p.date], other)
