"""Exact top-k by inner product: pivot-table elimination.

For each vector the distances to some pivots are computed once. By the triangle inequality the largest difference of two vectors'
distances to a pivot is a lower bound of their distance, and with the norms an upper bound of their inner product.

Vectors are dealt into cells by their nearest centre, large cells into blocks. A query first asks its own block, which gives it a
first k-th score. Then it goes only to cells whose bound, from the least and greatest distances of the cell to each pivot, reaches
that score. In a block candidates are evaluated in the order of their bounds until none left reaches a query's k-th score so far, for
some hundred queries at a time. Each candidate is sent once, and a block's queries are read as a stream.

Defined results: rows with a null vec_id, null vectors and such with null or non-finite components take no part. A shorter vector
counts as one with zeros at its end. With fewer than k candidates all are given. Of rows with the same vec_id none is a candidate
for the other, and the least of their vectors is asked. An empty table gives an empty result. Other columns are ignored. Scores are
exact while they fit 63 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .vectors import clean, matrix, sample


_QUERIES = 256  # at a time
_FEW = 4  # pivots that all candidates of a block are held against
_PRODUCTS = 1024  # candidates at a time


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    pivots: int = 32
    sample: int = 2000  # vectors that pivots and centres are chosen from
    centres: int = 512  # at most: what tasks know of cells is bounded
    block: int = 4096  # candidates in a block, about
    seed: int = 3


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Each the vector farthest from those before."""
    if not len(x):
        return x
    at, far = [0], np.full(len(x), np.inf)
    while len(at) < min(n, len(x)):
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
        at.append(int(far.argmax()))
    return x[at]


def _square_distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], to.shape[1])
    x, to = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, to))
    return np.maximum(0, (x * x).sum(1)[:, None] + (to * to).sum(1) - 2 * (x @ to.T))


_ROW = "vec_id long, v array<double>, sq double, d array<double>, cell int"


def _placed(points: np.ndarray, pivots: int, cells: int):
    """Rows with their squared norm, distances to the pivots, which are the first points, and the nearest of the first `cells` points."""

    def run(batches):
        for b in batches:
            x = matrix(b.column("v").to_pylist(), points.shape[1])
            d = _square_distances(x, points)
            cols = pa.array((x * x).sum(1)), pa.array(list(np.sqrt(d[:, :pivots])), pa.list_(pa.float64())), pa.array(d[:, :cells].argmin(1), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), *cols], names=["vec_id", "v", "sq", "d", "cell"])

    return run


def _farther(q: dict, c: dict, s: slice, pivots: slice, cols: np.ndarray, low: np.ndarray) -> None:
    """Raises the lower bounds of distances to what some pivots give."""
    gap = np.empty_like(low)
    for a, b in zip(q["d"][s, pivots].T, c["d"][cols, pivots].T):
        np.subtract(a[:, None], b, out=gap)
        np.abs(gap, out=gap)
        np.maximum(low, gap, out=low)


def _ceilings(q: dict, c: dict, s: slice, cols: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products, -inf for a query itself."""
    total = q["sq"][s, None] + c["sq"][cols]
    bound = (total - low * low) / 2 + 1e-9 * (1 + total)  # and room for rounding
    bound[q["id"][s, None] == c["id"][cols]] = -np.inf
    return bound


def _best(scores: np.ndarray, ids: np.ndarray, k: int, none) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best scores, ties to smaller ids, and the ids; rows with fewer are filled with `none`."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > none))
    else:
        row, col = np.nonzero(scores > none)
    score, own = scores[row, col], ids[row, col]
    order = np.lexsort((own, -score, row))
    row, score, own = row[order], score[order], own[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    out, who = np.full((len(scores), k), none, scores.dtype), np.zeros((len(scores), k), np.int64)
    out[row[kept], place[kept]], who[row[kept], place[kept]] = score[kept], own[kept]
    return out, who


def search(q: dict, c: dict, k: int, count: list | None = None):
    """(query_id, vec_id, score) arrays: the best k of a block of candidates for each query, of those that reach its score so far.

    Many queries at a time: bounds by some pivots for all candidates, by more of them as long as these rule out an eighth of what is
    left; then exact products in the order of the bounds, until no query has a candidate left that reaches its k-th score. count: gets the number of products made.
    """
    width = max(q["x"].shape[1], c["x"].shape[1])
    qx, cx = (np.pad(m["x"], ((0, 0), (0, width - m["x"].shape[1]))) for m in (q, c))
    kind = np.float64
    if np.abs(qx).max(initial=0) * np.abs(cx).max(initial=0) * width >= 2**53:  # sums of doubles wouldn't be exact
        qx, cx, kind = qx.astype(np.int64), cx.astype(np.int64), np.int64
    none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    out = []
    for first in range(0, len(qx), _QUERIES):
        s = slice(first, min(first + _QUERIES, len(qx)))
        kth = q["kth"][s].astype(float)
        cols = np.arange(len(cx))
        low, used, known = np.zeros((len(kth), len(cols))), 0, np.isfinite(kth).any()
        while True:
            _farther(q, c, s, slice(used, used + _FEW), cols, low)
            used += _FEW
            bound = _ceilings(q, c, s, cols, low)
            some = (bound >= kth[:, None]).any(0)
            gone = len(cols) - int(some.sum())
            if known and gone:
                cols, bound, low = cols[some], bound[:, some], low[:, some]
            # Further pivots are worth it while they rule out; without a score to reach none can.
            if not known or used >= q["d"].shape[1] or 8 * gone < gone + len(cols):
                break
        order = np.argsort(-bound.max(0, initial=-np.inf), kind="stable")
        cols, bound = cols[order], bound[:, order]
        rest = np.maximum.accumulate(bound[:, ::-1], axis=1)[:, ::-1]
        best, who = np.full((len(kth), k), none, kind), np.zeros((len(kth), k), np.int64)
        at = 0
        while at < len(cols):
            ask = np.flatnonzero((rest[:, at] >= kth) & (rest[:, at] > -np.inf))
            if not len(ask):
                break
            part = slice(at, at + (4 * k if at == 0 and not known else _PRODUCTS))
            scores = qx[s][ask] @ cx[cols[part]].T
            reaches = (bound[ask, part] >= kth[ask, None]) & (bound[ask, part] > -np.inf)
            if count is not None:
                count.append(scores.size)
            scores = np.where(reaches, scores, none)
            ids = np.broadcast_to(c["id"][cols[part]], scores.shape)
            best[ask], who[ask] = _best(np.concatenate([best[ask], scores], 1), np.concatenate([who[ask], ids], 1), k, none)
            full = best[ask, -1] > none
            kth[ask] = np.where(full, np.maximum(kth[ask], _down(best[ask, -1])), kth[ask])
            at = part.stop
        row, col = np.nonzero(best > none)
        out.append((q["id"][s][row], who[row, col], best[row, col].astype(np.int64)))
    return [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _down(x: np.ndarray) -> np.ndarray:
    """x as doubles that are no greater."""
    y = x.astype(float)
    return np.where(np.abs(y) < 2.0**53, y, y - np.abs(y) * 3e-16)


def _arrays(bs: list[pa.RecordBatch]) -> dict:
    t = pa.Table.from_batches(bs)
    return {"id": t.column("vec_id").to_numpy(), "x": matrix(t.column("v").to_pylist()), "sq": t.column("sq").to_numpy(), "d": matrix(t.column("d").to_pylist()), "kth": t.column("kth").to_numpy()}


def _asked(k: int):
    """Over rows sorted by block, candidates (asks = false) before queries."""

    def run(batches):
        block, held, table = None, [], None
        for b in batches:
            at, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if i == j:
                    continue
                if at[i] != block:
                    block, held, table = at[i], [], None
                part = b.slice(i, j - i)
                if not asks[i]:
                    held.append(part)
                elif held:
                    table = table or _arrays(held)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in search(_arrays([part]), table, k)], names=["query_id", "vec_id", "score"])

    return run


def _reached(cells: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray, first: np.ndarray, many: np.ndarray):
    """Queries with each block they go to: those of cells whose bound reaches their score so far, but for their own block."""

    def run(batches):
        for b in batches:
            d, sq, kth, own = matrix(b.column("d").to_pylist(), low.shape[1]), *(b.column(c).to_numpy() for c in ("sq", "kth", "block"))
            for i in range(0, len(d), 256):
                s = slice(i, i + 256)
                gap = np.maximum(d[s, None, :] - high[None], low[None] - d[s, None, :]).max(2, initial=0)
                total = sq[s, None] + norm[None]
                q, c = np.nonzero((total - gap * gap) / 2 + 1e-9 * (1 + total) >= kth[s, None])
                n = many[c]
                q, to = np.repeat(i + q, n), np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                q, to = q[to != own[q]], to[to != own[q]]
                rows = b.select(["vec_id", "v", "sq", "d", "kth"]).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to, pa.int64()), pa.array(np.full(len(q), True))], names=[*rows.schema.names, "block", "asks"])

    return run


_MET = "query_id long, vec_id long, score long"


def top_k(queries: DataFrame, rows: DataFrame, p: TopKParams = TopKParams()) -> DataFrame:
    """queries, rows: vec_id, v array<double>. Gives query_id, rank, vec_id, score."""
    some = sample(rows, p.sample, p.seed)
    n = rows.count()
    wanted = min(p.centres, max(1, n // p.block))
    points = choose_pivots(some, max(p.pivots, wanted)) if len(some) else np.zeros((1, 1))
    centres = min(wanted, len(points))
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    rows, queries = (materialise(x.select("vec_id", "v").mapInArrow(_placed(points, p.pivots, centres), _ROW)) for x in (rows, queries))
    used = min(p.pivots, len(points))
    spans = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("sq").alias("sq"), *(f(F.col("d")[i]).alias(f"{a}{i}") for i in range(used) for f, a in ((F.min, "lo"), (F.max, "hi")))).toArrow().sort_by("cell")
    cells, sizes, norm = (spans[c].to_numpy() for c in ("cell", "n", "sq"))  # one row for each centre
    low, high = (np.stack([spans[f"{a}{i}"].to_numpy() for i in range(used)], 1) for a in ("lo", "hi"))
    many = np.maximum(1, -(-sizes // p.block))
    first = np.cumsum(many) - many
    # Cells are blocks one after the other; which block of its cell a vector is in, a hash decides. A query's cell may have no rows.
    number = F.array(*map(F.lit, _by_cell(cells, first, centres))), F.array(*map(F.lit, _by_cell(cells, many, centres, 1)))
    block = (number[0][F.col("cell")] + F.pmod(F.xxhash64(F.lit(p.seed), "vec_id"), number[1][F.col("cell")])).alias("block")
    names = ["vec_id", "v", "sq", "d"]
    candidates = rows.select(*names, F.lit(0.0).alias("kth"), block, F.lit(False).alias("asks"))
    nothing = F.lit(float("-inf")).alias("kth")
    own = queries.select(*names, nothing, block, F.lit(True).alias("asks"))

    def met(asking: DataFrame) -> DataFrame:
        both = candidates.unionByName(asking).repartition(int(max(1, many.sum())), "block").sortWithinPartitions("block", "asks")
        return both.mapInArrow(_asked(p.k), _MET)

    found = materialise(met(own))
    least = F.min("score").cast("double")
    down = F.when(F.abs(least) < 2.0**53, least).otherwise(least - F.abs(least) * 3e-16)  # no greater than the score itself
    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= p.k, down).alias("k"))
    known = queries.join(kth, F.col("vec_id") == F.col("query_id"), "left").select(*names, F.coalesce("k", F.lit(float("-inf"))).alias("kth"), block)
    more = known.mapInArrow(_reached(cells, low, high, norm, first, many), "vec_id long, v array<double>, sq double, d array<double>, kth double, block long, asks boolean")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.unionByName(met(more)).withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def _by_cell(cells: np.ndarray, values: np.ndarray, n: int, rest: int = -1) -> list[int]:
    out = np.full(n, rest, np.int64)
    out[cells] = values
    return out.tolist()


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(64 * x).cast("double")).alias("v"))
    return top_k(rows.where("vec_id % 20 = 0"), rows)


#: All pairs of queries and candidates, in whole numbers.
OP8_SQL = """
with v as (select vec_id, list_transform(cast(embedding as double[]), lambda x: floor(64 * x)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(cast(embedding as double[]), lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
