"""Substring removal: difference-cover anchors.

Positions modulo 31 that lie in a difference cover D are anchors, each standing for the 20 words from it on. For any two positions
there is a shift below 31 that takes both into D, so two equal windows of 50 words hold an equal anchor at the same place. Anchors
that occur in more than one document are extended to all windows around them; among these windows, hashed in 128 bits, one that a
document with a smaller doc_id has too is removed. No pairs of documents are formed: each step counts or joins on a hash.

Defined results: null texts have no words; a text of under 50 words is kept whole. A row with a null doc_id keeps all its words and
takes none from others. Rows with the same doc_id do not take words from each other. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents, materialise, mix64, slices, small_batches

WINDOW = 50
PERIOD = 31
#: Every residue modulo 31 is a difference of two of these.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TEXTS = 4_000_000  # bytes of texts that go to a Python worker at a time
_GROUPS = 16 << 20  # bytes of a written table's row groups
_POWERS: list[np.ndarray] = []


def _powers(n: int):
    """For both multipliers: powers 0..n and inverse powers 0..n modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(12, (n + 1).bit_length())
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for m in _M for x in (m, pow(m, -1, 1 << 64))]
    return _POWERS


def window_hashes(h: np.ndarray, length: int, at: np.ndarray, stream: int = 0) -> np.ndarray:
    """64-bit hashes of `length` words from each position of `at` on; the two streams are independent."""
    pw = _powers(len(h))
    up, down = pw[2 * stream], pw[2 * stream + 1]
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mix64(h) if stream else h) * up[: len(h)])])
    return mix64((s[at + length] - s[at]) * down[at])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def anchor_positions(n: int, window: int = WINDOW) -> np.ndarray:
    if n < window:
        return np.zeros(0, np.int64)
    p = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return p[p <= n - ANCHOR]


def _anchors(batches):
    for b in slices(batches):
        ts, hs = [], []
        for x, t in zip(b.column("text").to_pylist(), b.column("t1").to_pylist()):
            words = (x or "").encode().split()
            if len(words) >= WINDOW:
                h = np.unique(window_hashes(word_hashes(words), ANCHOR, anchor_positions(len(words))))
                hs.append(h.view(np.int64))
                ts.append(np.full(len(h), t))
        if hs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ts))], names=["h", "t1"])


_CAND_DDL = "doc_id long, t1 long, t2 long, n_words long, copy boolean, sha string, text string, w1 array<long>, w2 array<long>, pos array<int>"
_CAND = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_words", pa.int64()), ("copy", pa.bool_()), ("sha", pa.string()), ("text", pa.string()), ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))])
_NO_WORDS = sha256(b"").hexdigest()


def _windows(batches):
    """Per document: its number of words and its words' digest; if it has a shared anchor, its text and the windows around such anchors."""
    for b in slices(batches):
        out = []
        for i, t1, t2, x, got, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t1", "t2", "text")), b.column("hs"), b.column("copy").to_pylist()):
            words = (x or "").encode().split()
            copy = bool(copy) and len(words) >= WINDOW
            row = {"doc_id": i, "t1": t1, "t2": t2, "n_words": len(words), "copy": copy, "sha": _NO_WORDS if copy else sha256(b" ".join(words)).hexdigest(), "text": None, "w1": None, "w2": None, "pos": None}
            if i is not None and got.is_valid and len(words) >= WINDOW and not copy:
                h = word_hashes(words)
                at = anchor_positions(len(words))
                at = at[np.isin(window_hashes(h, ANCHOR, at).view(np.int64), got.values.to_numpy())]
                near = np.unique((at[:, None] - np.arange(PERIOD)).ravel())
                near = near[(near >= 0) & (near <= len(words) - WINDOW)]
                if len(near):
                    row |= {"text": x, "w1": window_hashes(h, WINDOW, near).view(np.int64), "w2": window_hashes(h, WINDOW, near, 1).view(np.int64), "pos": near}
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, _CAND)


def _kept(batches):
    names = ["doc_id", "t1", "t2", "n_words", "n_removed", "kept_sha256", "kept_text"]
    for b in slices(batches):
        removed, digest, texts = [], [], []
        for n, copy, sha, x, pos in zip(*(b.column(c).to_pylist() for c in ("n_words", "copy", "sha", "text")), b.column("pos")):
            if not pos.is_valid:
                removed.append(n if copy else 0), digest.append(sha), texts.append("" if copy else None)
                continue
            words = x.encode().split()
            step = np.zeros(len(words) + 1, np.int64)
            at = pos.values.to_numpy()
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            gone = np.cumsum(step[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            removed.append(int(gone.sum())), digest.append(sha256(kept).hexdigest()), texts.append(kept.decode())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n_words, n_removed, kept_sha256, kept_text (null: nothing removed) of each row of docs."""
    with small_batches(docs.sparkSession, _TEXTS):
        return _removed(docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")))


def _removed(docs: DataFrame) -> DataFrame:
    anchors = docs.where("doc_id is not null").select("text", "t1").mapInArrow(_anchors, "h long, t1 long")
    shared = materialise(anchors.groupBy("h").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo < hi").select("h"))
    hits = anchors.join(shared, "h", "left_semi").groupBy("t1").agg(F.collect_set("h").alias("hs"))
    # Of equal texts the one with the smallest doc_id speaks for all; each window of the others starts in that document too.
    classes = docs.where("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("first"))
    classes = materialise(classes.join(hits, "t1", "left"))
    cand = docs.join(classes, ["t1", "t2"], "left").select("doc_id", "t1", "t2", "text", "hs", (F.col("doc_id") > F.col("first")).alias("copy")).mapInArrow(_windows, _CAND_DDL)
    cand = materialise(cand, _GROUPS)
    rows = cand.where("pos is not null").select("doc_id", F.inline(F.arrays_zip("w1", "w2", "pos")))
    least = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    key = ["doc_id", "t1", "t2"]
    rows = cand.where("pos is not null").select(*key, F.inline(F.arrays_zip("w1", "w2", "pos")))
    gone = rows.join(materialise(least), ["w1", "w2"]).where("doc_id > lo").groupBy(key).agg(F.collect_set("pos").alias("pos"))
    out = cand.drop("pos", "w1", "w2").join(gone, key, "left").select(*key, "n_words", "copy", "sha", "text", "pos")
    return materialise(out.mapInArrow(_kept, "doc_id long, t1 long, t2 long, n_words long, n_removed long, kept_sha256 string, kept_text string"), _GROUPS)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
