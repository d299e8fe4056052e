"""Quantiles of whole tables by selection of ranks, against numpy; and the operators that use them without a group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import cross as X
from quantloom.operators import selection as S

LEVELS = [0.0, 0.001, 0.05, 0.25, 0.5, 0.731, 0.95, 0.999, 1.0]


def column(kind, n=4000):
    r = np.random.default_rng(7)
    x = {"normal": r.normal(size=n), "heavy": np.exp(12 * r.normal(size=n)), "ties": r.integers(0, 5, n).astype(float), "one value": np.full(n, 2.5), "two values": np.where(r.random(n) < 0.4, 1.0, 1.5), "few": r.normal(size=3)}[kind]
    return [None if r.random() < 0.05 else float(v) for v in x]


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "one value", "two values", "few"])
@pytest.mark.parametrize(("few", "accuracy"), [(10, 20), (50, 1000), (S.FEW, 10_000)])
def test_quantiles_are_exact(spark, kind, few, accuracy):
    x = column(kind)
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(3)
    got = S.exact_quantiles(df, {"a": ("x", LEVELS), "b": (-F.col("x"), [0.3])}, few, accuracy)
    v = np.array([y for y in x if y is not None])
    assert np.allclose(got["a"], np.quantile(v, LEVELS), rtol=1e-12, atol=0) and np.allclose(got["b"], np.quantile(-v, [0.3]), rtol=1e-12)
    percentiles = df.agg(*(F.percentile("x", F.lit(q)).alias(f"q{i}") for i, q in enumerate(LEVELS))).first()
    assert list(percentiles) == got["a"]


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert S.exact_quantiles(df, {"a": ("x", [0.5, 0.9])}) == {"a": [None, None]} == S.exact_quantiles(df.where("false"), {"a": ("x", [0.5, 0.9])})


def test_operators_without_a_group(spark):
    x = column("normal")
    df = spark.createDataFrame(list(enumerate(x)), "id long, x double").repartition(3)
    v = np.array([np.nan if y is None else y for y in x])
    lo, hi = np.nanquantile(v, [0.05, 0.9])
    least, most = v[v >= lo].min(), v[v <= hi].max()
    rows = {r.id: r for r in X.classify(X.winsorize(X.trim(df, "x", (0.05, 0.1), "keep", []), "x", (0.05, 0.1), "w", []), "x", [0.3, 0.7], "cls", []).collect()}
    a, b = np.nanquantile(v, [0.3, 0.7])
    for i, y in enumerate(v):
        assert rows[i].keep == (lo <= y <= hi)
        assert (rows[i].w is None and rows[i].cls is None) if np.isnan(y) else (rows[i].w == min(max(y, least), most) and rows[i].cls == int(y > a) + int(y > b))
    one_sided = {r.id: r.w for r in X.winsorize(df, "x", (None, 0.1), "w", []).collect()}
    assert all(np.isnan(y) or one_sided[i] == min(y, most) for i, y in enumerate(v))
    none = X.winsorize(X.classify(df.where("x is null"), "x", 3, "cls", []), "x", (0.1, 0.1), "w", [])
    assert none.where("cls is not null or w is not null").count() == 0


def test_plans_have_no_percentile(spark):
    df = spark.range(100).withColumn("x", F.rand(1))
    plan = X.winsorize(X.classify(df, "x", 5, "cls", []), "x", (0.1, 0.1), "w", [])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
