"""Packing documents into windows of token ids: minimum bin slack.

A document's ids are cut into full windows and a rest. Rests are alike if they are alike in length, so a window's filling is a
multiset of lengths: for the longest rest that is left, subset sums of the remaining lengths, as bits of one integer, tell how near
the window can be filled, and backtracking tells how many of each length do it. A filling without slack is used as often as the
counts of its lengths allow. Where even the closest filling leaves slack, the windows take their lengths end to end and the piece
that reaches over the end is cut, so these are full too. Of the very last tokens each power of two is a sequence of its own: nothing
is padded.

The plan depends on counts by length only. There are fewer lengths than the window has tokens, each filling leaves one of its
lengths with fewer than it needs, so the plan has at most some thousands of entries, whatever the table's size. Documents are
numbered within a length by the task that encodes them, and tasks by sums over tasks; from its number a row finds its windows in the plan.

Defined results: null and empty texts are the end id alone. Rows alike in doc_id are packed each, and rows without one too. An empty
table gives no rows. Other columns are ignored. Very long texts are many full windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, give_back, materialise, slices, small_batches
from .tokenfiles import BATCH, VOCABULARY, _encoder

CAPACITY = 1024


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of a multiset of lengths those that come closest to `room` without more, as counts by length; of fillings as close, one of long pieces."""
    mask, reach, parts, before = (1 << room + 1) - 1, 1, [], []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n, k = min(counts[length], room // length), 1
        while n and not reach >> room & 1:
            k = min(k, n)
            parts.append((length, k)), before.append(reach)
            reach |= reach << length * k & mask
            n, k = n - k, 2 * k
    at, take = reach.bit_length() - 1, {}
    for (length, k), had in zip(reversed(parts), reversed(before)):
        if not had >> at & 1:
            take[length] = take.get(length, 0) + k
            at -= length * k
    return take


@dataclass(frozen=True)
class Plan:
    """Entries by (length, first number): `each` pieces of that length go to each window, the first at `offset` of window `window`.
    An entry of the tail has each = 0, and offset is its place in the tail."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    tail: int  # the tail's first window
    cuts: np.ndarray  # where the tail's sequences of less than a window begin, and where the last one ends
    capacity: int


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """counts: rests by length, all below the capacity."""
    left = {k: n for k, n in counts.items() if k and n}
    entries, used, window, loose = [], dict.fromkeys(left, 0), 0, []
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            take = fill({k: n for k, n in left.items() if n}, capacity - longest)
            left[longest] += 1
            take[longest] = take.get(longest, 0) + 1
            if sum(k * n for k, n in take.items()) < capacity:
                break
            times, at = min(left[k] // n for k, n in take.items()), 0
            for k in sorted(take, reverse=True):
                entries.append((k, used[k], take[k], window, at))
                at += k * take[k]
                used[k] += take[k] * times
                left[k] -= take[k] * times
            window += times
        if left[longest]:
            loose.append((longest, left[longest]))
            left[longest] = 0
    end = 0
    for k, n in loose:
        entries.append((k, used[k], 0, window, end))
        end += k * n
    whole, rest = end // capacity * capacity, end % capacity
    cuts = np.cumsum([whole, *(1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1)])
    columns = np.array(sorted(entries), np.int64).reshape(-1, 5).T
    return Plan(*columns, window, cuts, capacity)


def places(p: Plan, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, offset, length) of the pieces that rests of given lengths and numbers become, in order."""
    rows = np.flatnonzero(length)
    if not len(rows):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    size, n = length[rows], number[rows]
    # Entries are in order of (length, first); the last one at or before a rest is its own.
    lo, hi = np.searchsorted(p.length, size, "left"), np.searchsorted(p.length, size, "right") - 1
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        down = p.first[mid] > n
        hi, lo = np.where(down, mid - 1, hi), np.where(down, lo, mid)
    since, each = n - p.first[lo], p.each[lo]
    direct = each > 0
    q, slot = np.divmod(since, np.maximum(each, 1))
    out = [(rows[direct], (p.window[lo] + q)[direct], (p.offset[lo] + slot * size)[direct], size[direct])]
    row, at, size = rows[~direct], (p.offset[lo] + since * size)[~direct], size[~direct]
    end = at + size
    while len(row):  # once for each sequence that a piece reaches into
        whole = at < p.cuts[0]
        k = np.maximum(np.searchsorted(p.cuts, at, "right") - 1, 0)
        begin = np.where(whole, at // p.capacity * p.capacity, p.cuts[k])
        stop = np.where(whole, begin + p.capacity, p.cuts[np.minimum(k + 1, len(p.cuts) - 1)])
        out.append((row, p.tail + np.where(whole, at // p.capacity, p.cuts[0] // p.capacity + k), at - begin, np.minimum(end, stop) - at))
        more = end > stop
        row, at, end = row[more], stop[more], end[more]
    row, window, offset, size = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(row, kind="stable")
    return row[order], window[order], offset[order], size[order]


def encoded(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """p, rest, k, full, doc_id, n, ids: each document's ids, little-endian, the end id 0 last; k: rows of the task p before it whose
    rest has the same length, full: the full windows that these have."""

    def run(batches):
        width, encode = _encoder(vocabulary)
        p, seen, full = TaskContext.get().partitionId(), np.zeros(capacity, np.int64), np.zeros(capacity, np.int64)
        for b in slices(batches, most=BATCH):
            flat, ends = encode(b.column("text"), b"\0" * width)
            n = np.diff(ends, prepend=0)
            rest, windows = n % capacity, n // capacity
            order = np.argsort(rest, kind="stable")
            first = np.searchsorted(rest[order], rest[order], "left")
            before = np.cumsum(windows[order]) - windows[order]
            k, f = np.empty_like(n), np.empty_like(n)
            k[order] = np.arange(len(n)) - first + seen[rest[order]]
            f[order] = before - before[first] + full[rest[order]]
            np.add.at(seen, rest, 1), np.add.at(full, rest, windows)
            raw, at = flat.tobytes(), (ends * width).tolist()  # bytes: Arrow keeps what a memoryview shows for good
            ids = pa.array([raw[i:j] for i, j in zip([0, *at], at)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), p)), pa.array(rest), pa.array(k), pa.array(f), b.column("doc_id").cast(pa.int64()), pa.array(n), ids], names=["p", "rest", "k", "full", "doc_id", "n", "ids"])
        give_back()

    with small_batches(docs.sparkSession, BATCH):
        return materialise(docs.select("doc_id", "text").mapInArrow(run, "p long, rest long, k long, full long, doc_id long, n long, ids binary"), 16 << 20)


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 4 bytes each) of every piece. docs: doc_id, text."""
    rows = encoded(docs, vocabulary, capacity)
    tasks = rows.groupBy("p", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n") / capacity)).cast("long").alias("windows"))
    before = W.partitionBy("rest").orderBy("p").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    tasks = materialise(tasks.withColumns({c: F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in (("k0", "n"), ("full0", "windows"))}))
    totals = {r["rest"]: (r["n"], r["windows"]) for r in tasks.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows")).collect()}  # a row for each length, below the capacity
    windows = np.zeros(capacity + 1, np.int64)  # full windows come first, by the length of the rest that follows
    for r, (_, w) in totals.items():
        windows[r + 1] = w
    begins = np.cumsum(windows)
    made = plan({r: n for r, (n, _) in totals.items()}, capacity)
    pieces = rows.join(tasks.select("p", "rest", "k0", "full0"), ["p", "rest"]).select("doc_id", "n", "rest", (F.col("k") + F.col("k0")).alias("k"), (F.col("full") + F.col("full0")).alias("full"), "ids")

    def run(batches):
        for batch in batches:
            for b in slices([batch], "ids"):
                n, rest, k, full = (b.column(c).to_numpy() for c in ("n", "rest", "k", "full"))
                row, window, offset, length = places(made, rest, k)
                count = n // capacity
                frow = np.repeat(np.arange(len(n)), count)
                fk = np.arange(len(frow)) - np.repeat(np.cumsum(count) - count, count)
                # A rest's pieces follow its document's full windows.
                first = np.searchsorted(row, row, "left")
                upto = np.cumsum(length) - length
                start = (n - rest)[row] + upto - (upto[first] if len(row) else 0)
                row, start, length = np.concatenate([frow, row]), np.concatenate([fk * capacity, start]), np.concatenate([np.full(len(frow), capacity), length])
                window, offset = np.concatenate([begins[rest[frow]] + full[frow] + fk, begins[-1] + window]), np.concatenate([np.zeros(len(frow), np.int64), offset])
                ids = b.column("ids")
                at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
                width = int((at[-1] - at[0]) // max(1, n.sum()))
                flat = np.frombuffer(ids.buffers()[2], np.uint8)[at[0] : at[-1]].view(f"<u{width}").astype("<u4")
                place = ((at[:-1] - at[0]) // width)[row] + start
                raw = flat.tobytes()
                out = pa.array([raw[i:j] for i, j in zip((place * 4).tolist(), ((place + length) * 4).tolist())], pa.binary())
                doc, tokens = b.column("doc_id").take(pa.array(row)), pa.array(n[row])
                yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(length), tokens, pa.array(window), pa.array(offset), out], schema=PIECE)
        give_back()

    with small_batches(docs.sparkSession, BATCH):
        return materialise(pieces.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"), 16 << 20)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, starts, ids: each sequence put together from its pieces, which are at most as many as a window has tokens."""
    by = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("x"))
    whole = F.aggregate("x", F.lit(b""), lambda a, y: F.concat(a, y["ids"]))
    return by.select("sequence_id", F.col("x.doc_id").alias("doc_ids"), F.col("x.start").alias("starts"), whole.alias("ids"))


def op11_bin_slack_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
