"""Mixing sources to target weights: subset-sum budget fitting.

A source's budget is some whole passes over its documents and a rest. The rest is fitted on the source's counts of documents by
exact length: of each length the share that the rest is of the source, rounded down; then longest lengths first; then a bounded
knapsack by dynamic programming over what little of the budget is left. Which documents of a length are taken is decided by a
seeded hash of their ids, ranked in parts of at most 1/`parts` of a length, so that no length is sorted in one task.

Defined results: null and empty texts have size 0 and are never taken; a source without words has target 0; an empty table gives
an empty result. Rows that are alike in doc_id, size and source may be taken in part. A null source is a source, the last one.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, uniform


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (1, 2, 3)  # of the sources by code point, repeating
    most: int = 3  # times that a document can be taken
    exact_below: int = 131_072  # words of the budget that the dynamic programming fits
    parts: int = 256
    seed: int = 17


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, so that the sum comes as near to the budget as can be; of two as near, the smaller."""
    take = np.zeros(len(sizes), np.int64)
    most = budget + int(sizes[counts > 0].max(initial=0))  # beyond that, a sum without one of its parts is as near
    reach, via = np.zeros(most + 1, bool), np.full(most + 1, -1)
    reach[0] = True
    stages = []
    for i, (size, n) in enumerate(zip(sizes.tolist(), counts.tolist())):
        n, k = min(n, most // size) if size else 0, 1
        while n and not reach[budget]:
            k = min(k, n)
            w = size * k
            new = reach[:-w] & ~reach[w:]
            via[w:][new] = len(stages)
            reach[w:] |= new
            stages.append((i, k, w))
            n, k = n - k, 2 * k
    sums = np.flatnonzero(reach)
    at = int(sums[np.abs(sums - budget).argmin()])
    while at:
        i, k, w = stages[via[at]]
        take[i] += k
        at -= w
    return take


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, exact_below: int) -> np.ndarray:
    """How many documents of each size to take for a budget of words, at most the sum of sizes * counts."""
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    take = np.array([n * budget // total if s else 0 for s, n in zip(sizes.tolist(), counts.tolist())], np.int64)
    left = budget - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order.tolist():
        if sizes[i] and left > exact_below:
            k = min(int(counts[i] - take[i]), (left - exact_below) // int(sizes[i]))
            take[i] += k
            left -= k * int(sizes[i])
    return take + knapsack(sizes, counts - take, left)


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """s, sn (the source and whether it is null), source_size, target of each source. The rows are sources, few and small."""
    by = sizes.groupBy("s", "sn").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(W.orderBy("sn", "s")) - 1) % len(p.weights)
    by = by.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in p.weights)), (rank + 1).cast("int")))
    # Sources that stop at their limit come first in this order; what is left is shared by weight.
    by = by.withColumn("limit", p.most * F.col("source_size").cast("double"))
    before = W.orderBy(F.col("limit") / F.col("w"), "sn", "s")
    by = by.withColumn("all", F.sum(F.col("source_size").cast("double")).over(W.partitionBy()))
    by = by.withColumn("share", (F.col("all") - F.coalesce(F.sum("limit").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(before.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("stops", F.col("limit") <= F.col("share") * F.col("w"))
    # The first source that doesn't stop has the share that all later ones get.
    first = F.first(F.when(~F.col("stops"), F.col("share")), ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return by.select("s", "sn", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(first * F.col("w")).alias("target"))


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """docs: doc_id, source, size long. Gives doc_id, size, source_size, target, taken."""
    rows = materialise(docs.select("doc_id", "size", F.coalesce("source", F.lit("")).alias("s"), F.isnull("source").alias("sn"), uniform(F.col("doc_id"), seed=p.seed).alias("u")))
    rows = rows.withColumn("part", F.floor(F.col("u") * p.parts).cast("int"))
    goal = targets(rows, p)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialise(goal.withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))
    parts = materialise(rows.where("size > 0").groupBy("s", "sn", "size", "part").agg(F.count("*").alias("n")))
    lengths = parts.groupBy("s", "sn", "size").agg(F.sum("n").alias("n")).join(F.broadcast(goal.select("s", "sn", "budget")), ["s", "sn"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        take = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]), p.exact_below)
        return pdf.assign(k=take)[["s", "sn", "size", "k"]]

    take = lengths.groupBy("s", "sn").applyInPandas(fitted, "s string, sn boolean, size long, k long")
    upto = F.sum("n").over(W.partitionBy("s", "sn", "size").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    cut = parts.withColumn("upto", upto).join(take, ["s", "sn", "size"])
    cut = materialise(cut.select("s", "sn", "size", "part", F.greatest(F.lit(0), F.least("n", F.col("k") - F.col("upto") + F.col("n"))).alias("k"), "n"))
    rows = rows.join(cut, ["s", "sn", "size", "part"], "left").join(F.broadcast(goal.drop("budget")), ["s", "sn"])
    some = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    whole = rows.where(~F.coalesce(some, F.lit(False))).withColumn("more", F.coalesce((F.col("k") > 0).cast("int"), F.lit(0)))
    ranked = F.row_number().over(W.partitionBy("s", "sn", "size", "part").orderBy("u", "doc_id"))
    split = rows.where(some).withColumn("more", (ranked <= F.col("k")).cast("int"))
    return whole.unionByName(split).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with a last column size: the number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(sized(documents(spark, sf_dir).select("doc_id", "source", "text")))
