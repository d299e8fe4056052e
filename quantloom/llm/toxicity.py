"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (lower-cased, ASCII punctuation and white space between words): words, word pairs, and pairs with one or
two words between, each present or absent, hashed. Per-coordinate rates and L1 leave few weights that aren't zero; those are
what is sent to the executors. The fit takes a bounded sample of the labelled rows, on several shards whose weights are averaged.

Defined results: null and empty texts get the score of the bias alone; with no labelled rows every score is 0. Rows with a null
doc_id are scored, not learned from, and held_out is false for them. Of several labels of one doc_id the largest counts;
repeated documents give repeated results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, documents, fold, mix64, slices, uniform

#: A-Z to a-z, ASCII punctuation and controls to a blank.
_CLEAN = bytes(32 if b < 128 and not chr(b).isalnum() else LOWER[b] for b in range(256))


@dataclass(frozen=True)
class ToxicParams:
    bits: int = 20
    per_class: int = 5000  # rows of each label that are sampled for the fit: the bound of the sample
    shards: int = 1  # more than one: their weights are averaged
    epochs: int = 8
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    skips: tuple[int, ...] = (1, 2, 3)  # distance of the second word of a pair
    seed: int = 5


@dataclass
class ToxicModel:
    weights: np.ndarray  # float32 by bucket, mostly zero
    bias: float
    params: ToxicParams


def features(text: bytes, p: ToxicParams) -> np.ndarray:
    """Buckets of all words and pairs of a text, repeats included."""
    words = text.translate(_CLEAN).split()
    h = mix64(np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1))
    shift = np.uint64(64 - p.bits)
    parts = [h >> shift]
    for d in p.skips:
        if len(h) > d:
            parts.append(((h[:-d] * np.uint64(2 * d + 1) + (h[d:] ^ (h[d:] >> np.uint64(29)))) * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    return np.concatenate(parts).astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit_shard(p: ToxicParams):
    def run(batches):
        rows = []
        for b in batches:
            for t, y, o, c in zip(*(b.column(x).to_pylist() for x in ("text", "toxic", "order", "weight"))):
                rows.append((o, y, c, np.unique(features((t or "").encode(), p)).astype(np.int32)))
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        z, n, bz, bn = np.zeros(1 << p.bits), np.zeros(1 << p.bits), 0.0, 0.0

        def weights(z, n):
            return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

        for _ in range(p.epochs):
            for _, y, c, idx in rows:
                zi, ni = z[idx], n[idx]
                w, b = weights(zi, ni), -bz / ((p.beta + bn**0.5) / p.alpha)
                g = c * (_sigmoid(w.sum() + b) - y)
                z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
                n[idx] = ni + g * g
                bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / p.alpha * b
                bn += g * g
        w = weights(z, n)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], -bz / ((p.beta + bn**0.5) / p.alpha)))], names=["bucket", "w"])

    return run


def fit(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams()) -> ToxicModel | None:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1), one row for a doc_id. Only weights, at most 2**bits, reach the driver.

    The labels are sampled before their documents are looked up; what is broadcast is at most about 2 * per_class ids.
    """
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    if not counts:
        return None
    part = {k: min(1.0, p.per_class / n) for k, n in counts.items()}
    pick = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col("toxic")]
    # A label sampled more thinly than the other counts for more, so that the prior stays.
    top = max(part.values())
    picked = labels.where(uniform(F.col("doc_id"), seed=p.seed) < pick(part)).select("doc_id", F.col("toxic").cast("int").alias("y"), uniform(F.col("doc_id"), seed=p.seed + 1).alias("order"), pick({k: top / v for k, v in part.items()}).alias("weight"))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("y").alias("toxic"), "order", "weight")
    rows = sample.repartition(p.shards, F.floor(F.col("order") * 1_000_003)).mapInArrow(_fit_shard(p), "bucket long, w double").groupBy("bucket").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    n = max((r[2] for r in rows if r[0] < 0), default=1)
    w, bias = np.zeros(1 << p.bits, np.float32), 0.0
    for r in rows:
        if r[0] < 0:
            bias = r[1] / n
        else:
            w[r[0]] = r[1] / n
    return ToxicModel(w, bias, p)


def score(docs: DataFrame, m: ToxicModel | None) -> DataFrame:
    """doc_id, score of each row of docs."""
    if m is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    at = np.flatnonzero(m.weights).astype(np.int32)
    values, bias, p = m.weights[at], m.bias, m.params

    def run(batches):
        w = np.zeros(1 << p.bits, np.float32)
        w[at] = values
        for b in slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                h = features((t or "").encode(), p)
                out.append(float(_sigmoid(bias + w[np.unique(h[w[h] != 0])].sum(dtype=np.float64))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    m = fit(docs, labels)
    out = score(docs, m)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
