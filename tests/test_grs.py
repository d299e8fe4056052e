"""The GRS test from cross products against least squares on the returns themselves."""

import numpy as np
import pytest

from quantloom.operators import analytics as A
from quantloom.operators import joins as J


def plain(r, f):
    t, n, k = len(r), r.shape[1], f.shape[1]
    x = np.column_stack([np.ones(t), f])
    b = np.linalg.lstsq(x, r, rcond=None)[0]
    e = r - x @ b
    sigma, omega, mu = e.T @ e / (t - k - 1), np.atleast_2d(np.cov(f.T)), f.mean(0)
    return t / n * (t - n - k) / (t - k - 1) * (b[0] @ np.linalg.solve(sigma, b[0])) / (1 + mu @ np.linalg.solve(omega, mu))


@pytest.mark.parametrize("k", [1, 3])
def test_statistic_over_the_dates_that_are_there(spark, k):
    r = np.random.default_rng(k)
    f = 0.01 * r.normal(size=(150, k)) + 0.004
    a = f @ r.normal(size=(k, 5)) + 0.02 * r.normal(size=(150, 5)) + 0.002
    assets = [(i, *map(float, x)) for i, x in enumerate(a) if i % 7]
    assets[10] = (assets[10][0], None, *assets[10][2:])  # a missing return, and dates that only one table has
    factors = [(i, *map(float, x)) for i, x in enumerate(f) if i < 140] + [(999, *[0.0] * k)]
    got = A.grs_test(spark.createDataFrame(assets, ["date", *"abcde"]).repartition(3), spark.createDataFrame(factors, ["date", *(f"b{i}" if i else "b" for i in range(k))]), "date")
    rows = [i for i, *x in assets if i < 140 and None not in x]
    assert np.isclose(got["grs"], plain(a[rows], f[rows]), rtol=1e-9) and 0 <= got["p"] <= 1


def test_too_few_dates(spark):
    one = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.2, 0.1)], "date int, a double, b double")
    assert np.isnan(A.grs_test(one, one.select("date", "a"), "date")["grs"])


def test_inspect_counts_infinities(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, float("inf")), (2, 1, None), (2, 2, 3.0), (3, 1, float("-inf"))], "date int, id int, x double")
    (r,) = J.inspect(df, "date", "id").collect()
    assert (r.rows, r.nulls, r.infs, r.mean, r.min, r.p50, r.max, r.dates, r.ids) == (5, 1, 2, 2.0, 1.0, 2.0, 3.0, 3, 2)
    assert {tuple(x) for x in J.ids_by_date(df, "date").collect()} == {(1, 2), (2, 2), (3, 1)}
