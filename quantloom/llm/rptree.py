"""Embedding near-duplicates: a random-projection tree forest.

Trees are grown on a bounded sample: each node splits at the median of a random direction, and vectors near the median go to both
sides. All vectors are dealt to the leaves of all trees; the vectors of a leaf are compared, pairs are verified in double
precision, and what each leaf joins is united: a leaf gives one edge for each vector it joins to others, not all its pairs. A leaf
with too many vectors splits on, by the same rule and directions of its own, in its task. Equal vectors are one entry with a count.

Every link lies within a component of what the leaves join, so links are counted there: the vectors of a component are compared
block by block, each pair of blocks in a task of its own, and only counts come back; small components share a block.

Defined results: a vector that is null, zero, or has null or non-finite components links with nothing and is kept, also one with
a null vec_id. A shorter vector counts as one with zeros at its end. Rows with the same vec_id are counted each. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components
from .vectors import clean, matrix, sample


@dataclass(frozen=True)
class ForestParams:
    least: float = 0.95  # cosine
    trees: int = 10
    leaf: int = 400  # vectors expected in a leaf
    spill: float = 0.06  # share of a node's vectors on each side of the median that go to both
    sample: int = 20_000
    block: int = 1024  # vectors of a component that are compared with as many
    seed: int = 29


def grow(x: np.ndarray, leaf: int, spill: float, rng: np.random.Generator) -> list:
    """Nodes of a tree: (direction, low, high, left, right); None for a leaf. A vector goes left up to high and right from low on."""
    nodes: list = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(rows) > leaf and depth < 40:
            u = rng.standard_normal(x.shape[1])
            t = x[rows] @ u
            low, mid, high = np.quantile(t, [0.5 - spill, 0.5, 0.5 + spill])
            left, right = rows[t <= high], rows[t >= low]
            if max(len(left), len(right)) < 0.9 * len(rows) and low < high:
                nodes[at] = (u, low, high, node(left, depth + 1), node(right, depth + 1))
        return at

    node(np.arange(len(x)), 0)
    return nodes


def leaves(tree: list, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows of x) for each leaf that gets rows."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if tree[at] is None or not len(rows):
            if len(rows):
                out.append((at, rows))
            continue
        u, low, high, left, right = tree[at]
        t = x[rows] @ u
        todo += [(left, rows[t <= high]), (right, rows[t >= low])]
    return out


def joined(ids: np.ndarray, x: np.ndarray, p: ForestParams, rng: np.random.Generator) -> np.ndarray:
    """Rows (id, smaller id it is joined to) of the vectors of one leaf that a chain of cosines of at least p.least joins; leaves over four times the expected size split on."""
    x = x / np.sqrt((x * x).sum(1))[:, None]
    out = []
    for _, rows in leaves(grow(x, p.leaf, p.spill, rng), x) if len(x) > 4 * p.leaf else [(0, np.arange(len(x)))]:
        label = np.arange(len(rows))
        for i in range(0, len(rows), 1024):
            near = linked(x[rows[i : i + 1024]], x[rows], p.least)
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            r, c = np.nonzero(near)
            r += i
            while len(r):  # labels fall to the smallest that is reached, block by block
                low = np.minimum(label[r], label[c])
                before = label.copy()
                np.minimum.at(label, label[r], low)
                np.minimum.at(label, label[c], low)
                label = label[label]
                if (label == before).all():
                    break
        while (label != label[label]).any():
            label = label[label]
        low = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids[rows])
        more = ids[rows] != low[label]
        out.append(np.stack([ids[rows][more], low[label][more]], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether each vector of a and each of b (of norm 1) have a cosine of at least `least`; what is that near to it is calculated again."""
    cos = a @ b.T
    near = cos >= least
    r, c = np.nonzero(np.abs(cos - least) < 1e-12)
    for i in range(0, len(r), 4096):
        x, y = a[r[i : i + 4096]], b[c[i : i + 4096]]
        near[r[i : i + 4096], c[i : i + 4096]] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= least
    return near


def links(distinct: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """distinct: vec_id long, v array<double>, not zero. Gives edges a, b that join vectors with a cosine of at least p.least, directly or by others."""
    some = sample(distinct, p.sample, p.seed)
    if not len(some):
        return distinct.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b")).where("false")
    some /= np.sqrt((some * some).sum(1))[:, None]
    n = distinct.count()
    rng = np.random.default_rng(p.seed)
    trees = [grow(some, max(8, p.leaf * len(some) // n), p.spill, rng) for _ in range(p.trees)]
    width = some.shape[1]

    def dealt(batches):
        for b in batches:
            x = matrix(b.column("v").to_pylist(), width)
            x = (x / np.sqrt((x * x).sum(1))[:, None])[:, :width]
            for k, tree in enumerate(trees):
                for leaf, rows in leaves(tree, x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k), pa.int32()), pa.array(np.full(len(rows), leaf), pa.int32()), b.column("vec_id").take(pa.array(rows)), b.column("v").take(pa.array(rows))], names=["tree", "leaf", "vec_id", "v"])

    def compared(key, t):
        rng = np.random.default_rng([p.seed, key[0].as_py(), key[1].as_py()])
        pairs = joined(t.column("vec_id").to_numpy(), matrix(t.column("v").to_pylist()), p, rng)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    rows = distinct.select("vec_id", "v").mapInArrow(dealt, "tree int, leaf int, vec_id long, v array<double>")
    return rows.groupBy("tree", "leaf").applyInArrow(compared, "a long, b long")


def count_links(rows: DataFrame, p: ForestParams) -> DataFrame:
    """rows: vec_id long, v, n (equal vectors), root. Gives a, near: how many vectors link with each, itself not counted."""
    size = rows.groupBy("root").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(size, "root")
    # A small component goes whole to one of many groups, a large one is cut into blocks of which each pair is a group.
    small = F.col("size") <= p.block
    total = rows.where(small).count()
    blocks = F.ceil(F.col("size") / p.block).cast("int")
    own = F.when(small, 0).otherwise(F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    rows = rows.withColumn("g", F.when(small, F.pmod(F.xxhash64("root"), F.lit(max(1, total // p.block)))).otherwise(-1)).withColumn("own", own)
    other = F.explode(F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("other", other).withColumn("whole", F.when(small, 0).otherwise(F.col("root")))
    rows = rows.select("g", "whole", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "vec_id", "n", "v")

    def compared(key, t):
        i, j = key[2].as_py(), key[3].as_py()
        x, n, root, own, ids = matrix(t.column("v").to_pylist()), *(t.column(c).to_numpy() for c in ("n", "root", "own", "vec_id"))
        x = x / np.sqrt((x * x).sum(1))[:, None]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = np.zeros(len(ids), np.int64)
        for k in range(0, len(left), 1024):
            a = left[k : k + 1024]
            near = linked(x[a], x[right], p.least) & (root[a][:, None] == root[right][None, :]) & (a[:, None] != right[None, :])
            out[a] += near @ n[right]
            if i != j:
                out[right] += n[a] @ near
        return pa.table({"a": ids, "near": out})

    return rows.groupBy("g", "whole", "i", "j").applyInArrow(compared, "a long, near long").groupBy("a").agg(F.sum("near").alias("near"))


def near_duplicates(vectors: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding)."""
    rows = clean(vectors).where(F.exists("v", lambda x: x != 0))
    classes = materialise(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    reps = classes.select(F.col("rep").alias("vec_id"), "v", "n")
    roots = materialise(components(links(reps, p)))
    known = reps.join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id"))
    known = materialise(known)
    near = count_links(known, p)
    known = known.join(near.withColumnRenamed("a", "vec_id"), "vec_id", "left")
    known = materialise(known.select("v", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.col("root").alias("component_id")))
    linked = rows.join(known, "v").select("vec_id", "n_links", "component_id")
    # Rows that take no part.
    fine = F.col("embedding").cast("array<double>")
    out = F.coalesce(F.col("vec_id").isNotNull() & F.forall(fine, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(fine, lambda x: x != 0), F.lit(False))
    rest = vectors.where(~out).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
