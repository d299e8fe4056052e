"""Panels: rows keyed by id and date, and the operators along an id's time.

A panel's rows are `freq` to a year, its information `base_freq` to a year; m = freq / base_freq rows make one base period. All
distances are in base periods. Shifts are by rows, so a panel should have no gaps: populate() comes first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import ZERO, col, div

ANNUAL, QUARTERLY, MONTHLY, DAILY = 1, 4, 12, 365
_RN = "_rn"
_STEP = {ANNUAL: 12, QUARTERLY: 3, MONTHLY: 1}
_TESTS = {"==": lambda c, v: c == v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(list(v))}
#: These keep rows in which the column is null.
_NOT = {"!=": lambda c, v: (c != v) | c.isNull(), "not in": lambda c, v: ~c.isin(list(v)) | c.isNull()}


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    id: str = "id"
    date: str = "date"
    freq: int = MONTHLY
    base_freq: int = MONTHLY

    @property
    def m(self) -> int:
        return max(1, self.freq // self.base_freq)

    @property
    def by_id(self):
        return W.partitionBy(self.id).orderBy(self.date)

    @property
    def by_phase(self):
        """Of each id every m-th row; the panel needs numbered() if m > 1."""
        return self.by_id if self.m == 1 else W.partitionBy(self.id, F.col(_RN) % self.m).orderBy(self.date)

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.id, self.date, _RN)]

    def of(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def with_columns(self, **cols: Column) -> Panel:
        return self.of(self.df.withColumns(cols))

    def numbered(self) -> Panel:
        return self if _RN in self.df.columns else self.with_columns(**{_RN: self.row_count()})

    # Columns along time

    def row_count(self, ascending: bool = True) -> Column:
        """Number of rows of the id before this one, or after it."""
        order = self.by_id if ascending else W.partitionBy(self.id).orderBy(F.desc(self.date))
        return F.row_number().over(order) - 1

    def shift(self, c: str | Column, n: int = 1) -> Column:
        k = n * self.m
        return F.lag(col(c), k).over(self.by_id) if k > 0 else F.lead(col(c), -k).over(self.by_id) if k < 0 else col(c)

    def diff(self, c: str | Column, n: int = 1) -> Column:
        return col(c) - self.shift(c, n)

    def pct_change(self, c: str | Column, n: int = 1, negative_base: bool = False) -> Column:
        """c over its value n periods before, less one; null where that value isn't positive, or, with negative_base, is zero."""
        base = self.shift(c, n)
        return div(c, base if negative_base else F.when(base > ZERO, base)) - 1

    def rolling(self, c: str | Column, n: int, how: str, min_n: int | None = None, lag: int = 0) -> Column:
        """how: sum, mean, std, var, min, max of the n periods up to `lag` periods ago (negative: ahead); null with under min_n values."""
        w = self.by_phase.rowsBetween(-(n - 1) - lag, -lag)
        f = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max}[how]
        return F.when(F.count(col(c)).over(w) >= (min_n or n), f(col(c)).over(w))

    def cumret(self, ret: str | Column, period: int = 1, lag: int = 0) -> Column:
        """Return from `period` to `lag` periods ago; for a negative period, of the periods ahead.

        Ahead by more than one period, an id's first rows are null too: the window runs over the shifted column and must be full.
        """
        if (period, lag) in ((1, 0), (-1, 0)):
            return self.shift(ret, min(0, period))
        n = abs(period - lag)
        out = F.expm1(self.rolling(F.log1p(col(ret)), n, "sum", lag=lag if period > 0 else period))
        if period > 0:
            return out
        k = n - 1 if period < 0 else 0
        return F.when(F.row_number().over(self.by_id) > k * self.m, out)

    def futret(self, ret: str | Column, period: int = 1) -> Column:
        return self.cumret(ret, -period)

    def future_return(self, ret: str | Column, period: int = 1) -> Column:
        """Return of the next periods, also in an id's first rows."""
        return F.expm1(self.rolling(F.log1p(col(ret)), period, "sum", lag=-period))

    def rolling_regression(self, y: str, x: str, n: int, min_n: int | None = None) -> dict[str, Column]:
        """Columns const, beta, r2, ivol of least squares of y on x over the last n periods with both; ivol: sample deviation of the residuals."""
        w = self.by_phase.rowsBetween(-(n - 1), 0)
        enough = F.count(F.when(F.col(x).isNotNull(), F.col(y))).over(w) >= (min_n or n)
        both = F.when(F.col(x).isNotNull(), F.col(y).cast("double"))
        r2 = F.regr_r2(F.col(y), F.col(x)).over(w)
        cols = {"const": F.regr_intercept(F.col(y), F.col(x)).over(w), "beta": F.regr_slope(F.col(y), F.col(x)).over(w), "r2": r2, "ivol": F.sqrt(F.var_samp(both).over(w) * F.greatest(F.lit(0.0), 1 - r2))}
        return {k: F.when(enough, v) for k, v in cols.items()}

    # Rows

    def remove_rows(self, n: int = 1) -> Panel:
        """Values of each id's first n periods (last, if negative) as null."""
        count = self.row_count(n > 0)
        keep = self.df.withColumn("_k", count >= abs(n) * self.m)
        return self.of(keep.withColumns({c: F.when(F.col("_k"), F.col(c)) for c in self.values}).drop("_k"))

    def filter(self, filters: list[tuple], keep_row: bool = False) -> Panel:
        """Rows that pass all (column, test, value); with keep_row the others stay, with null values.

        != and not in pass a null; with keep_row the other tests leave a row with a null as it is.
        """
        df = self.df
        for c, test, v in filters:
            passes = _NOT[test](F.col(c), v) if test in _NOT else _TESTS[test](F.col(c), v)
            if keep_row:
                fails = ~F.coalesce(passes, F.lit(True))
                df = df.withColumn("_f", fails).withColumns({x: F.when(~F.col("_f"), F.col(x)) for x in self.values}).drop("_f")
            else:
                df = df.where(F.coalesce(passes, F.lit(False)))
        return self.of(df)

    def shifted(self, n: int = 1, but: tuple[str, ...] = ()) -> Panel:
        return self.with_columns(**{c: self.shift(c, n) for c in self.values if c not in but})

    def populate(self, freq: int, limit: int | None = None, lag: int = 0, source_date: str | None = None, fill: bool = True) -> Panel:
        """The panel on a gap-free calendar from each id's first to its last date, each row filling up to `limit` rows after it (None or 0, or without fill: none).

        Of several rows in one calendar step the last counts. lag shifts all values by rows of the new panel.
        """
        step = _STEP[freq]
        months = lambda d: F.year(d) * 12 + F.month(d) - 1
        at = F.floor(months(F.col(self.date)) / step)
        src = self.df.drop(_RN).withColumn("_at", at)
        src = src.withColumn("_last", F.row_number().over(W.partitionBy(self.id, "_at").orderBy(F.desc(self.date)))).where("_last = 1").drop("_last")
        if source_date:
            src = src.withColumn(source_date, F.col(self.date))
        span = src.groupBy(self.id).agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
        grid = span.select(self.id, F.explode(F.sequence("lo", "hi")).alias("_at"))
        values = [c for c in src.columns if c not in (self.id, self.date, "_at")]
        out = grid.join(src.drop(self.date).withColumn("_src", F.struct("_at", *values)).select(self.id, "_at", "_src"), [self.id, "_at"], "left")
        if fill and limit:
            seen = F.last("_src", ignorenulls=True).over(W.partitionBy(self.id).orderBy("_at"))
            out = out.withColumn("_src", seen).withColumn("_src", F.when(F.col("_at") - F.col("_src._at") <= limit, F.col("_src")))
        end = F.last_day(F.make_date(F.floor((F.col("_at") * step + step - 1) / 12).cast("int"), ((F.col("_at") * step + step - 1) % 12 + 1).cast("int"), F.lit(1)))
        out = out.select(self.id, end.alias(self.date), *(F.col(f"_src.{c}").alias(c) for c in values))
        new = replace(self, df=out, freq=freq)
        if lag:
            new = new.with_columns(**{c: F.lag(c, lag).over(new.by_id) for c in values})
        return new


def to_month_end(date: str | Column) -> Column:
    return F.last_day(col(date))


def add_months(date: str | Column, n: int) -> Column:
    """n month ends on; from within a month the first is that month's end."""
    d = col(date)
    inside = d != F.last_day(d)
    return F.last_day(F.add_months(d, F.when(inside & F.lit(n > 0), n - 1).otherwise(n)))
