"""Column functions for data with missing values. Missing is null throughout; NaN and infinities never arise here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magnitudes below this count as zero.
ZERO = 1e-7


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: str | Column) -> Column:
    """c, or 0 where it is null."""
    return F.coalesce(col(c), F.lit(0.0))


def div(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def is_zero(c: str | Column) -> Column:
    return F.abs(col(c)) < ZERO


def flag(condition: Column) -> Column:
    """1 or 0; 0 where the condition is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sum_present(*cs: str | Column) -> Column:
    """Sum of those that aren't null; null if all are."""
    cs = [col(c) for c in cs]
    return F.when(F.coalesce(*cs).isNotNull(), reduce(lambda a, b: a + b, (nz(c) for c in cs)))


def mean_present(*cs: str | Column) -> Column:
    cs = [col(c) for c in cs]
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cs))
    return div(sum_present(*cs), n)


def clamp(c: str | Column, lo: Column, hi: Column) -> Column:
    """c within [lo, hi]; a null limit is none, a null c stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo))


def sample_skewness(c: str | Column) -> Column:
    """Adjusted skewness of a sample (aggregate); null for under three values or no variance."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point columns with NaN and infinities as null; for what comes from outside."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
