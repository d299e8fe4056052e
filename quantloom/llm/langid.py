"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The n-grams of one to three characters (letters lower-cased, all else a blank) are hashed. Document frequencies come from
all training documents. The model is fitted on a bounded sample of labelled rows, by follow-the-regularised-leader with an
elastic-net penalty on several shards whose weights are averaged; a part of the sample kept from fitting gives the temperature.

Defined results: a text that is null or has no letter is `und` with score 0; with nothing to learn from, every text is `und`.
Rows with a null doc_id are predicted, not learned from, and held_out is false for them. Repeated rows give repeated results.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import blocks, documents, fold, slices, uniform

UND = "und"
ORDERS = 3
_ALPHA: np.ndarray | None = None


@dataclass(frozen=True)
class LangParams:
    bits: int = 17  # 2**bits buckets of n-grams
    per_class: int = 1200  # labelled rows of each language that are sampled for the fit: the bound of the sample
    shards: int = 4
    epochs: int = 4
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    scale: float = 20.0  # of a feature: scale * idf * relative frequency
    calibration: float = 0.25  # part of the sample that only sets the temperature
    seed: int = 11


@dataclass
class LangModel:
    labels: list[str]
    weights: np.ndarray  # (buckets, languages), times idf and scale already
    bias: np.ndarray
    temperature: float
    params: LangParams


def _alpha() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA


def ngrams(texts: list[str], bits: int):
    """For a run of texts: has a letter (per text), first position of each text, and per order the bucket of the n-gram at each position.

    Each text stands between blanks, so that no n-gram touches two texts.
    """
    joined = "".join(f" {x.lower()}  " for x in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = _alpha()[cp]
    cp = np.where(letter, cp, np.uint64(32))
    starts = np.cumsum([0, *(len(x.lower()) + 3 for x in texts)])[:-1]
    has = np.add.reduceat(letter, starts) > 0
    shift, out = np.uint64(64 - bits), []
    key = cp
    for n in range(1, ORDERS + 1):
        if n > 1:
            key = (key[:-1] << np.uint64(21)) ^ cp[n - 1 :] if n < 3 else key[:-1] * np.uint64(0x9E3779B1) + cp[n - 1 :]
        h = ((key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        out.append(np.concatenate([h, np.zeros(n - 1, np.uint64)]).astype(np.int64))
    return has, starts, out


def _frequencies(bits: int):
    def run(batches):
        df, seen, n = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool), 0
        for b in batches:
            texts = [x or "" for x in b.column(0).to_pylist()]
            for i, j in blocks(texts):
                _, starts, orders = ngrams(texts[i:j], bits)
                ends = [*starts[1:], len(orders[0])]
                for s, e in zip(starts, ends):
                    for h in orders:
                        seen[h[s:e]] = True
                    df += seen
                    seen[:] = False
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    return run


def _features(texts: list[str], bits: int, factor: np.ndarray):
    """Per text: buckets and values of its features."""
    for i, j in blocks(texts):
        _, starts, orders = ngrams(texts[i:j], bits)
        ends = [*starts[1:], len(orders[0])]
        for s, e in zip(starts, ends):
            idx, c = np.unique(np.concatenate([h[s:e] for h in orders]), return_counts=True)
            yield idx, factor[idx] * (c / (e - s))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def _fit_shard(labels: list[str], factor: np.ndarray, p: LangParams):
    """FTRL over the rows of one shard; gives its non-zero weights and the bias (bucket -1)."""
    k, at = len(labels), {x: i for i, x in enumerate(labels)}

    def run(batches):
        rows = []
        for b in batches:
            for feats, lang, order in zip(_features([x or "" for x in b.column("text").to_pylist()], p.bits, factor), b.column("lang").to_pylist(), b.column("u").to_pylist()):
                rows.append((order, at[lang], *feats))
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        z, n = np.zeros((1 << p.bits, k)), np.zeros((1 << p.bits, k))
        bz, bn = np.zeros(k), np.zeros(k)

        def weights(z, n, l1):
            return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

        for _ in range(p.epochs):
            for _, y, idx, x in rows:
                zi, ni = z[idx], n[idx]
                w, b = weights(zi, ni, p.l1), weights(bz, bn, 0.0)
                g0 = _softmax(x @ w + b)
                g0[y] -= 1
                g = x[:, None] * g0
                z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
                n[idx] = ni + g * g
                bz += g0 - (np.sqrt(bn + g0 * g0) - np.sqrt(bn)) / p.alpha * b
                bn += g0 * g0
        w, b = weights(z, n, p.l1), weights(bz, bn, 0.0)
        for c in range(k):
            i = np.flatnonzero(w[:, c])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.full(len(i) + 1, c)), pa.array(np.append(w[i, c], b[c]))], names=["bucket", "cls", "w"])

    return run


def _logits(texts: list[str], m: LangModel):
    """Per text: has a letter, logits."""
    has, out = np.zeros(len(texts), bool), np.zeros((len(texts), len(m.labels)))
    for i, j in blocks(texts):
        has[i:j], starts, orders = ngrams(texts[i:j], m.params.bits)
        total = sum(np.add.reduceat(m.weights[h], starts, axis=0, dtype=np.float64) for h in orders)
        out[i:j] = total / np.diff([*starts, len(orders[0])])[:, None] + m.bias
    return has, out


def fit(train: DataFrame, p: LangParams = LangParams()) -> LangModel | None:
    """train: doc_id, text, lang (not null). Only the counts of n-grams, at most 2**bits, and of languages reach the driver."""
    train = train.select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return None
    labels = sorted(counts)
    freq = train.select("text").mapInArrow(_frequencies(p.bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << p.bits)
    for r in freq:
        df[r[0]] = r[1]
    total = next(r[1] for r in freq if r[0] == -1)
    df[-1] = next((r[1] for r in freq if r[0] == (1 << p.bits) - 1), 0)
    factor = p.scale * (np.log((1 + total) / (1 + df)) + 1)
    part = F.create_map(*(F.lit(x) for k in labels for x in (k, min(1.0, p.per_class / counts[k]))))
    sample = train.withColumn("u", uniform(F.col("doc_id"), seed=p.seed)).where(F.col("u") < part[F.col("lang")])
    sample = sample.withColumn("u", uniform(F.col("doc_id"), seed=p.seed + 1))
    fitted = sample.where(F.col("u") >= p.calibration).repartition(p.shards, F.floor(F.col("u") * 1_000_003))
    rows = fitted.mapInArrow(_fit_shard(labels, factor, p), "bucket long, cls long, w double").groupBy("bucket", "cls").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    n = max((r[3] for r in rows if r[0] < 0), default=1)  # shards that had rows
    w, bias = np.zeros((1 << p.bits, len(labels))), np.zeros(len(labels))
    for r in rows:
        if r[0] < 0:
            bias[r[1]] = r[2] / n
        else:
            w[r[0], r[1]] = r[2] / n
    m = LangModel(labels, (w * factor[:, None]).astype(np.float32), bias, 1.0, p)
    m.temperature = _temperature(sample.where(F.col("u") < p.calibration), m)
    return m


def _temperature(held: DataFrame, m: LangModel) -> float:
    """The temperature of least negative log-likelihood over held rows (a bounded number)."""
    k = len(m.labels)

    def run(batches):
        for b in batches:
            _, x = _logits([t or "" for t in b.column("text").to_pylist()], m)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(list(x), pa.list_(pa.float64()))], names=["lang", "x"])

    got = held.select("text", "lang").mapInArrow(run, "lang string, x array<double>").collect()
    if not got or k < 2:
        return 1.0
    x, y = np.array([r[1] for r in got]), np.array([m.labels.index(r[0]) for r in got])
    ts = np.exp(np.linspace(np.log(0.2), np.log(5), 65))
    return float(min(ts, key=lambda t: -np.log(_softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean()))


def predict(docs: DataFrame, m: LangModel | None, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with two last columns, language and score; docs may have any columns but these two."""
    names = docs.columns

    def run(batches):
        for b in slices(batches):
            texts = b.column(names.index("text")).to_pylist()
            if m is None:
                lang, score = [UND] * len(texts), [0.0] * len(texts)
            else:
                has, x = _logits([t or "" for t in texts], m)
                pr = _softmax(x / m.temperature)
                best = pr.argmax(1)
                lang = [m.labels[i] if h else UND for i, h in zip(best, has)]
                score = np.where(has, pr.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, lang_name, score_name])

    schema = StructType([*docs.schema.fields]).add(lang_name, StringType()).add(score_name, DoubleType())
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    m = fit(training_rows(docs))
    out = predict(docs.select("doc_id", "text"), m)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
