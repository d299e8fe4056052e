"""Token files: raw ids in shards, each with a minimal perfect hash index of its document keys.

A shard is one file: the ids of its documents, in ascending doc_id order, as little-endian unsigned integers of 2 bytes (4 for a
vocabulary over 65,536), each document ended by id 0; then the index; then the index's length and a mark. The index maps a key in
constant time to the place of its ids: a hash gives a bucket, the bucket's pilot gives a slot that no other key has, and a 32-bit
fingerprint in the slot tells keys that aren't there. Spark's text writer writes the files: a document's row goes out as it is, and
the line separator, one zero byte, is the last byte of its id 0, so any file system that Spark writes to will do.

Documents are dealt into shards by ranges of doc_id, and of a hash within a doc_id, so that the order of the files is the order of
the documents and rows with one or no doc_id are no hot shard. The texts are encoded after that, in pieces that are looked up if met
before; new pieces go through the tokenizers library, also its added tokens, and plain words through its model alone. For lookups a manifest beside the files tells each shard's keys.

Defined results: null and empty texts have id 0 alone. Rows with a null doc_id come first. Rows with the same doc_id follow each
other, in an order that reruns keep, and a lookup gives all of them. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, give_back, materialise, mix64, scratch_dir, slices, small_batches
from .pieces import MARKS, PieceEncoder, byte_letters

VOCABULARY = "byte_bpe_50k.json"
SHARD_CHARS = 12_000_000
BATCH = 4_000_000  # bytes of texts that go to a Python worker at a time
MEMORY = 120_000_000  # bytes of pieces that a Python worker remembers
_TOGETHER = 512  # pieces: the library takes some hundred bytes for each letter, and more time for longer strings
_MARK = b"MPHIDX1\0"
_PER_BUCKET = 4
_SPACE = "\u0120"  # the vocabulary's letter for a space
_WORD = "^ [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u3041-\u3096\u4e00-\u9fa5\uac00-\ud7a3]+\\z"  # letters of all versions of Unicode
INK = r"^ [^\t-\r\x1c-\x20\x{85}\p{Z}]([^ ]*[^\t-\r\x1c-\x20\x{85}\p{Z}])?\z"  # one space, first, and no white space last


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: pilots by bucket; a bucket of one key has its slot, negative, in place of a pilot."""

    def __init__(self, pilots: np.ndarray, n: int):
        self.pilots, self.n = pilots, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        pilots = np.zeros(max(1, -(-n // _PER_BUCKET)), np.int64)
        free = np.ones(n, bool)
        bucket = (_hash(keys, 1) % np.uint64(len(pilots))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=len(pilots))
        ends = np.cumsum(size)
        base = _hash(keys, 2)
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            h, first, step = base[order[ends[b] - size[b] : ends[b]]], 1, 32
            while not pilots[b]:
                tried = np.arange(first, first + step, dtype=np.uint64)
                slots = np.sort((mix64(h[None, :] + mix64(tried)[:, None]) % np.uint64(n)).astype(np.int64), axis=1)
                good = free[slots].all(1) & (slots[:, 1:] != slots[:, :-1]).all(1)
                if good.any():
                    k = int(good.argmax())
                    pilots[b] = first + k
                    free[slots[k]] = False
                first, step = first + step, min(2 * step, 4096)
        single = np.flatnonzero(size == 1)
        pilots[single] = -1 - np.flatnonzero(free)[: len(single)]
        return cls(pilots, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; any slot for keys that aren't in the index."""
        pilot = self.pilots[(_hash(keys, 1) % np.uint64(len(self.pilots))).astype(np.int64)]
        by_hash = (mix64(_hash(keys, 2) + mix64(pilot.astype(np.uint64))) % np.uint64(max(1, self.n))).astype(np.int64)
        return np.where(pilot < 0, -1 - pilot, by_hash)


class Shard:
    """A shard file's ids and index."""

    def __init__(self, content: bytes):
        size, mark = struct.unpack("<q8s", content[-16:])
        if mark != _MARK:
            raise ValueError("not a token shard")
        at = len(content) - 16 - size
        width, rows, nulls, keys, buckets = struct.unpack_from("<5q", content, at)
        at += 40

        def read(dtype, n):
            nonlocal at
            a = np.frombuffer(content, dtype, n, at)
            at += a.nbytes
            return a

        self.width, self.nulls = width, nulls
        self.ends = read("<i8", rows)  # ids up to the end of each row
        self.pilots, self.prints = read("<i8", buckets), read("<u4", keys)
        self.first, self.count = read("<i4", keys), read("<i4", keys)  # by slot: the key's first row, and rows with it
        self.keys = read("<i8", keys)  # ascending
        self.hash = PerfectHash(self.pilots, keys)
        self.ids = np.frombuffer(content, f"<u{width}", int(self.ends[-1]) if rows else 0)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its first row, and its number of rows: 0 for a key that isn't here."""
        if not self.hash.n or not len(keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys)
        there = self.prints[slot] == (_hash(keys, 3) >> np.uint64(32)).astype(np.uint32)
        return np.where(there, self.first[slot], 0), np.where(there, self.count[slot], 0)

    def row(self, i: int) -> tuple[int, np.ndarray]:
        start = int(self.ends[i - 1]) if i else 0
        return start, self.ids[start : int(self.ends[i])]


def pack_index(width: int, doc_ids: pa.Array, ends: np.ndarray) -> bytes:
    """doc_ids ascending, nulls first; ends: ids up to the end of each row."""
    nulls = doc_ids.null_count
    keys, first, count = np.unique(doc_ids.slice(nulls).to_numpy(), return_index=True, return_counts=True)
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys) if len(keys) else np.zeros(0, np.int64)
    prints, f, c = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i4"), np.zeros(len(keys), "<i4")
    prints[slot], f[slot], c[slot] = (_hash(keys, 3) >> np.uint64(32)).astype(np.uint32), first + nulls, count
    body = struct.pack("<5q", width, len(doc_ids), nulls, len(keys), len(mph.pilots)) + ends.astype("<i8").tobytes() + mph.pilots.astype("<i8").tobytes() + prints.tobytes() + f.tobytes() + c.tobytes() + keys.astype("<i8").tobytes()
    return body + struct.pack("<q8s", len(body), _MARK)


def _bare(t) -> bool:
    """Whether words may go to a tokenizer's model without its pattern: it has the byte-level one alone, and a token for each byte, and
    each added token has a character that isn't in words or their letters."""
    has = json.loads(t.to_str())
    level = has["pre_tokenizer"] or {}
    alone = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level["add_prefix_space"] and not has["normalizer"] and not has["post_processor"]
    return bool(alone and has["model"]["type"] == "BPE" and all(t.token_to_id(c) is not None for c in byte_letters()) and all(re.search(r"[!-@\[-`{-~]", x["content"]) for x in has["added_tokens"]))


@lru_cache(1)
def _encoder(path: str, ordinary: bool = False, memory: int = MEMORY):
    """The bytes of an id, and encode(texts) -> ids, ends: the library's ids without special tokens, each text ended by id 0.
    ordinary: special tokens' strings in a text are text; memory: bytes of pieces that are remembered."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library would each keep memory
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = ordinary
    width = 2 if t.get_vocab_size() <= 1 << 16 else 4
    opens = np.array([(t.id_to_token(i) or "").startswith(_SPACE) for i in range(t.get_vocab_size())])
    # Pieces never cut an added token, as long as none has white space or takes any from its sides.
    added = t.get_added_tokens_decoder().values()
    whole = any(x.lstrip or x.rstrip or x.single_word or any(c.isspace() for c in x.content) for x in added)
    marks = not any(re.search(rf"[^\W\d_][{re.escape(MARKS)}]", x.content) for x in added)

    def ids(xs: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{width}") for e in t.encode_batch_fast(xs, add_special_tokens=False)]

    def joined(xs: list[str], at: list[int], tokenizer, text: Callable[[list[str]], str], out: list[bytes]) -> None:
        """Pieces are encoded as one string, which the library does faster; a piece's first token is its only one with a space."""
        for first in range(0, len(at), _TOGETHER):
            some = at[first : first + _TOGETHER]
            got = np.array(tokenizer.encode_batch_fast([text([xs[i] for i in some])], add_special_tokens=False)[0].ids, f"<u{width}")
            cuts = np.flatnonzero(opens[got])
            if len(cuts) == len(some) and cuts[0] == 0:
                raw, ends = got.tobytes(), (np.append(cuts, len(got)) * width).tolist()
                for i, k, j in zip(some, ends, ends[1:]):
                    out[i] = raw[k:j]

    # A word is one match of the pattern, so its bytes' letters go to the model without it; newlines, which are no byte's letter, part words.
    by_words = Tokenizer.from_file(path)
    by_words.pre_tokenizer = CharDelimiterSplit("\n")
    letter = np.zeros(256, "<u2")
    letter[list(byte_letters().values())] = list(map(ord, byte_letters()))
    letter[10] = 10

    def letters(xs: list[str]) -> str:
        return letter[np.frombuffer("\n".join(xs).encode(), np.uint8)].tobytes().decode("utf-16-le")

    bare = _bare(t)

    def pieces(xs: list[str]) -> list[bytes]:
        out, column = [b""] * len(xs), pa.array(xs, pa.large_string())
        if bare:
            joined(xs, np.flatnonzero(pc.match_substring_regex(column, _WORD)).tolist(), by_words, letters, out)
        opening = np.flatnonzero(pc.match_substring_regex(column, INK)).tolist()
        joined(xs, [i for i in opening if not out[i]], t, "".join, out)
        left = [i for i, x in enumerate(out) if not x]
        for i, x in zip(left, ids([xs[i] for i in left]) if left else ()):
            out[i] = x.tobytes()
        return out

    def plain(texts: pa.Array, end: bytes):
        got = [np.append(x, np.frombuffer(end, x.dtype)) for x in ids([x or "" for x in texts.to_pylist()])]
        return np.concatenate(got), np.cumsum([len(x) for x in got])

    return width, plain if whole else PieceEncoder(pieces, f"<u{width}", memory, marks).encode


def write(docs: DataFrame, path: str, vocabulary: str, shard_chars: int = SHARD_CHARS) -> None:
    """Writes the shards of docs (doc_id, text) to the folder `path`; shard_chars: bytes of text to a shard, about."""
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        width, encode = _encoder(vocabulary)
        ids, upto, end = [], [], 0
        for b in slices(batches):
            flat, ends = encode(b.column("text"), b"\0" * width)
            raw, at = flat.tobytes(), (ends * width).tolist()  # bytes: Arrow keeps what a memoryview shows for good
            ids.append(pa.array(b.column("doc_id").to_pylist(), pa.int64())), upto.append(ends + end)
            end += len(flat)
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : j - 1] for i, j in zip([0, *at], at)], pa.binary())], names=["value"])
        if ids:
            index = pack_index(width, pa.concat_arrays(ids), np.concatenate(upto))
            yield pa.RecordBatch.from_arrays([pa.array([index[:-1]], pa.binary())], names=["value"])
        give_back()

    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.repartitionByRange(max(1, -(-chars // shard_chars)), *order).sortWithinPartitions(*order)
    out = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none")
    with small_batches(docs.sparkSession, BATCH):
        out.text(path)


def write_manifest(spark: SparkSession, path: str) -> None:
    """Writes beside the shards the keys that each has, once, for lookups."""
    shards(spark, path).mapInArrow(_spans, "shard long, nulls long, least long, greatest long").write.mode("overwrite").parquet(f"{path}/_manifest")


def _spans(batches):
    """Of each shard the least and greatest key, and the rows without one."""
    for b in batches:
        got = [(n, s.nulls, *((int(s.keys[0]), int(s.keys[-1])) if len(s.keys) else (None, None))) for n, c in zip(b.column(0).to_pylist(), b.column(1)) for s in (Shard(c.as_buffer()),)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in list(zip(*got)) or [[]] * 4], names=["shard", "nulls", "least", "greatest"])


def shards(spark: SparkSession, path: str, numbers: list[int] | None = None) -> DataFrame:
    """shard (the number in the file's name), content of each shard file, or of those with the given numbers."""
    names = "part-*" if numbers is None else f"part-{{{','.join(f'{n:05d}' for n in numbers)}}}-*"
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).where("length > 0")
    return files.select(F.regexp_extract("path", r"/part-(\d+)", 1).cast("long").alias("shard"), "content")


_ROW = "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"


def _rows(batches):
    """Each document of each shard, by looking its key up."""
    for b in batches:
        for number, content in zip(b.column(0).to_pylist(), b.column(1)):
            s = Shard(content.as_buffer())
            first, count = s.find(s.keys)
            keys = pa.concat_arrays([pa.nulls(s.nulls, pa.int64()), pa.array(np.repeat(s.keys, count))])
            at = np.concatenate([np.arange(s.nulls), np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))])
            ends = s.ends[at]
            starts = np.where(at > 0, s.ends[at - 1], 0)
            crc = [crc32(s.ids[i:j].astype("<u4")) for i, j in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), keys, pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, ids of those keys (doc_id long, distinct) that the files hold. By the manifest a key goes to the shards whose range has
    it, and only shards that are asked are opened."""
    rows = spark.read.parquet(f"{path}/_manifest").where("least is not null").orderBy("least", "greatest").collect()  # one for each file
    number, least, greatest = (np.array([r[c] for r in rows], np.int64) for c in ("shard", "least", "greatest"))

    def dealt(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            lo, hi = np.searchsorted(greatest, k, "left"), np.searchsorted(least, k, "right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(number[at]), pa.array(np.repeat(k, n))], names=["shard", "doc_id"])

    asked = materialise(keys.select("doc_id").where("doc_id is not null").mapInArrow(dealt, "shard long, doc_id long"))
    wanted = [r[0] for r in asked.select("shard").distinct().collect()]  # numbers of shards

    def fetch(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, docs = [], []
        for content in right.column("content"):
            s = Shard(content.as_buffer())
            keys = left.column("doc_id").to_numpy()
            for doc, i, n in zip(keys.tolist(), *(x.tolist() for x in s.find(keys))):
                for k in range(i, i + n):
                    docs.append(doc), ids.append(s.row(k)[1].astype(np.int64))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return asked.groupBy("shard").cogroup(shards(spark, path, wanted).groupBy("shard")).applyInArrow(fetch, "doc_id long, ids array<long>")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark) + "/ids"
    write(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY))
    rows = materialise(shards(spark, path).mapInArrow(_rows, _ROW))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each shard
    base = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
