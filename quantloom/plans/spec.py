"""Characteristics as named SQL expressions over a panel, resolved into levels.

An expression may name columns of the panel and other expressions. Those that name no others are one projection, those that name
only these the next, and so on; so a hundred expressions are a few projections, and windows over the same id share one sort. The
text is SQL that Spark and DuckDB both read. A name that begins with `_` is a helper and isn't part of the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


@dataclass(frozen=True)
class Terms:
    """SQL of the operators along time: m rows are a period; the panel has the columns id, date and, if m > 1, ph (row number modulo m)."""

    m: int = 1
    jkp: bool = False  # variants of a published replication

    @property
    def over(self) -> str:
        return "over (partition by id order by date)"

    def frame(self, n: int, lag: int = 0) -> str:
        ph = ", ph" if self.m > 1 else ""
        end = "current row" if not lag else f"{lag} preceding"
        return f"over (partition by id{ph} order by date rows between {n - 1 + lag} preceding and {end})"

    def L(self, x: str, n: int = 1) -> str:
        return f"lag({x}, {n * self.m}) {self.over}"

    def D(self, x: str, n: int = 1) -> str:
        return f"(({x}) - {self.L(x, n)})"

    def G(self, x: str, n: int = 1) -> str:
        return f"(case when {self.L(x, n)} > 1e-7 then ({x}) / {self.L(x, n)} - 1 end)"

    def R(self, fn: str, x: str, n: int, least: int | None = None, lag: int = 0) -> str:
        f = {"sum": "sum", "mean": "avg", "std": "stddev_samp", "var": "var_samp"}[fn]
        w = self.frame(n, lag)
        return f"(case when count({x}) {w} >= {least or n} then {f}({x}) {w} end)"

    def cumret(self, x: str, period: int, lag: int = 0) -> str:
        """Of 1 + x's logarithms; a return of -1 or less has none."""
        return f"(exp({self.R('sum', f'case when {x} > -1 then ln(1 + {x}) end', period - lag, None, lag)}) - 1)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def nz(x: str) -> str:
    return f"coalesce({x}, 0)"


def above(x: str) -> str:
    """x, null if it isn't positive."""
    return f"(case when ({x}) >= 1e-7 then ({x}) end)"


def nonzero(x: str) -> str:
    return f"(case when abs({x}) >= 1e-7 then ({x}) end)"


def flag(c: str) -> str:
    return f"coalesce(cast(({c}) as int), 0)"


def total(*xs: str) -> str:
    """Sum of those that aren't null."""
    return f"(case when coalesce({', '.join(xs)}) is not null then {' + '.join(nz(x) for x in xs)} end)"


def levels(exprs: dict[str, str], wanted: list[str] | None = None) -> list[dict[str, str]]:
    """Projections for the wanted names (default: all) and what they need."""
    needs = {k: {n for n in _NAME.findall(v) if n in exprs and n != k} for k, v in exprs.items()}
    todo, need = list(wanted or exprs), set()
    while todo:
        k = todo.pop()
        if k not in need:
            need.add(k)
            todo += needs[k]
    out, done = [], set()
    while need - done:
        now = {k: exprs[k] for k in exprs if k in need and k not in done and needs[k] <= done}
        if not now:
            raise ValueError(f"circular: {sorted(need - done)}")
        out.append(now)
        done |= set(now)
    return out


def replaced(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    """df after projections, each of which adds or replaces columns."""
    for step in steps:
        keep = [f"`{c}`" for c in df.columns if c not in step]
        df = df.selectExpr(*keep, *(f"{v} as `{k}`" for k, v in step.items()))
    return df


def sql(source: str, columns: list[str], steps: list[dict[str, str]], outer: list[str]) -> str:
    """The same as SQL over a query of those columns; `outer`: the last select's expressions."""
    for step in steps:
        keep = [c for c in columns if c not in step]
        source = f"(select {', '.join([*keep, *(f'{v} as {k}' for k, v in step.items())])} from {source} t)"
        columns = [*keep, *step]
    return f"select {', '.join(outer)} from {source} t"


def create(df: DataFrame, exprs: dict[str, str], wanted: list[str] | None = None) -> DataFrame:
    """df with the wanted expressions as columns, helpers dropped."""
    names = [k for k in (wanted or exprs) if not k.startswith("_")]
    have = list(df.columns)
    out = replaced(df, levels(exprs, names))
    return out.select(*have, *(k for k in names if k not in have))
