"""Rows of a table of vectors that take part: no null, no component that is null or not finite."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import uniform


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>. Rows with a null vec_id take no part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def sample(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """At most `most` vectors of rows (vec_id, v), by a seeded hash of the ids; shorter vectors get zeros at their end."""
    n = rows.count()
    got = rows.where(uniform(F.col("vec_id"), seed=seed) < min(1.0, most / max(1, n))).select("vec_id", "v").orderBy("vec_id").limit(2 * most).collect()
    return matrix([r[1] for r in got])


def matrix(rows: list, width: int = 0) -> np.ndarray:
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out
