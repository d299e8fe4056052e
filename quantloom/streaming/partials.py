"""Sums per id and period of a stream, which the range windows over months take as they take those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partial_sums(stream: DataFrame, id: str, time: str, value: str, period: str = "1 day", late: str = "1 day") -> DataFrame:
    """id, start of the period, n, s, ss: number, sum and sum of squares; rows later than `late` behind the newest are left out."""
    v = F.col(value).cast("double")
    by = stream.withWatermark(time, late).groupBy(F.window(time, period).alias("w"), F.col(id).alias("id"))
    return by.agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")).select("id", F.col("w.start").alias("start"), "n", "s", "ss")
