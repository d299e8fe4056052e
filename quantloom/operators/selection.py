"""Exact quantiles of a whole table, by selection of ranks.

The value at a rank is found by narrowing an interval: a sketch of bounded size gives values on both sides of the rank, an exact count
tells how many rows lie below, at and between them, and what lies between is some thousandth of what was. When few enough rows are left,
these are counted by value and the rank is read off. Each pass is one aggregate that Spark combines in the tasks; no task holds the
column, however long it is, and ties cost nothing. The driver gets a few numbers a pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import col

#: Rows of an interval that one task puts in order.
FEW = 500_000
_ACCURACY = 10_000


@dataclass
class _Rank:
    """A rank, from 0, of column x: its value lies within (lo, hi), ends excluded and None for open, which holds `inside` rows above `below` others."""

    x: str
    rank: int
    inside: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    value: float | None = None

    def within(self) -> Column:
        x = F.col(self.x)
        out = x.isNotNull()
        if self.lo is not None:
            out &= x > self.lo
        return out if self.hi is None else out & (x < self.hi)


def _narrow(src: DataFrame, ranks: list[_Rank], accuracy: int) -> None:
    """Puts each rank into an interval between two values that a sketch has near it, or finds its value."""
    ask = []
    for i, r in enumerate(ranks):
        at, wide = (r.rank - r.below) / r.inside, 2 / accuracy
        ask.append(F.percentile_approx(F.when(r.within(), F.col(r.x)), [max(0.0, at - wide), min(1.0, at + wide)], accuracy).alias(f"r{i}"))
    ends = src.agg(*ask).first()
    count = []
    for i, r in enumerate(ranks):
        a, b = ends[f"r{i}"]
        x, inside = F.col(r.x), r.within()
        for k, c in (("below", x < a), ("a", x == a), ("mid", (x > a) & (x < b)), ("b", (x == b) & (x > a))):
            count.append(F.count_if(inside & c).alias(f"{k}{i}"))
    got = src.agg(*count).first()
    for i, r in enumerate(ranks):
        a, b = ends[f"r{i}"]
        at, below, mine, mid, also = r.rank - r.below, *(got[f"{k}{i}"] for k in ("below", "a", "mid", "b"))
        if at < below:  # the sketch's ends may lie beside the rank
            r.hi, r.inside = a, below
        elif at < below + mine:
            r.value = a
        elif at < below + mine + mid:
            r.lo, r.hi, r.below, r.inside = a, b, r.below + below + mine, mid
        elif at < below + mine + mid + also:
            r.value = b
        else:
            r.lo, r.below, r.inside = b, r.below + below + mine + mid + also, r.inside - below - mine - mid - also


def _read_off(src: DataFrame, ranks: list[_Rank]) -> None:
    """The values of ranks whose intervals hold few rows."""
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.when(r.within(), F.col(r.x)).alias("x"), F.lit(r.rank - r.below).alias("at")) for i, r in enumerate(ranks)))
    rows = src.select(F.inline(each)).where("x is not null").groupBy("i", "at", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("i").orderBy("x"))
    for row in rows.withColumn("upto", upto).where("upto > at").groupBy("i").agg(F.min("x").alias("x")).collect():  # a row for each rank
        ranks[row["i"]].value = row["x"]


def exact_quantiles(df: DataFrame, of: dict[str, tuple[str | Column, list[float]]], few: int = FEW, accuracy: int = _ACCURACY) -> dict[str, list[float | None]]:
    """name -> (column, levels) to name -> the quantiles at these levels of all values that aren't null, with linear interpolation;
    None where there are none. df is read some times: at least three, and twice more for each thousandfold of `few` rows."""
    src = df.select(*(col(c).cast("double").alias(f"x{i}") for i, (c, _) in enumerate(of.values())))
    counts = src.agg(*(F.count(c).alias(c) for c in src.columns)).first()
    wanted: dict[tuple[str, int], _Rank] = {}
    for x, (_, levels) in zip(src.columns, of.values()):
        for q in levels:
            if counts[x]:
                at = floor(q * (counts[x] - 1))
                wanted.setdefault((x, at), _Rank(x, at, counts[x]))
    ranks = list(wanted.values())
    while wide := [r for r in ranks if r.value is None and r.inside > few]:
        _narrow(src, wide, accuracy)
    if left := [r for r in ranks if r.value is None]:
        _read_off(src, left)
    if not ranks:
        return {k: [None] * len(levels) for k, (_, levels) in of.items()}
    after = src.agg(*(x.alias(f"{k}{i}") for i, r in enumerate(ranks) for k, x in (("n", F.count_if(F.col(r.x) <= r.value)), ("x", F.min(F.when(F.col(r.x) > r.value, F.col(r.x))))))).first()
    following = {(r.x, r.rank): r.value if after[f"n{i}"] > r.rank + 1 or after[f"x{i}"] is None else after[f"x{i}"] for i, r in enumerate(ranks)}

    def interpolated(x: str, q: float) -> float | None:
        if not counts[x]:
            return None
        at = q * (counts[x] - 1)
        lo = floor(at)
        if lo == at:
            return wanted[x, lo].value
        return (ceil(at) - at) * wanted[x, lo].value + (at - lo) * following[x, lo]

    return {k: [interpolated(x, q) for q in levels] for x, (k, (_, levels)) in zip(src.columns, of.items())}
