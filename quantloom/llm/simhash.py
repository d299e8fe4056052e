"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints with at most two differing bits share at least six of them in place, so of the
four two-byte groups at least two are equal, and the pair meets in at least one of six posting lists, one for each choice of two
groups. A pair that meets is tallied (bytes equal in place), kept at six or more, and verified on its bits. Equal fingerprints are
one entry of the index. A posting list over `dense` entries makes no pairs: its entries, which agree in four bytes, are dealt by
the other four and by these with each bit flipped; entries that meet there are at most two bits apart, entries at most two bits
apart do meet, and at most 33 can.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other. Repeated rows give
repeated results. With a null doc_id a row links and gets a component_id, but never gives it. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, documents, materialise, slices
from .components import components

MAX_BITS = 2
SHARED_BYTES = 8 - MAX_BITS
DENSE = 64
SHINGLE = 3
SEED = 42
_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `shingle` words, in order; a shorter text is one run, one without words has none."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - k].tolist()]
    return np.fromiter([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64, len(starts))


def bits(h: np.ndarray) -> int:
    """The majority of each of the 64 bits, as a signed integer."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), _AT_ONCE):
        part = h[i : i + _AT_ONCE]
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed integer."""
    return bits(shingle_hashes(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with a last column fp long; any columns, of which text is read."""
    names = docs.columns

    def run(batches):
        for b in slices(batches):
            fp = pa.array([fingerprint(x) for x in b.column(names.index("text")).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(names.index("doc_id")), fp], names=["doc_id", "fp"])

    return docs.select(*names).mapInArrow(run, "doc_id long, fp long")


def _group(c, i: int):
    return F.shiftrightunsigned(c, 16 * i).bitwiseAND(0xFFFF)


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """distinct: fp long, each once. Edges a, b that join every two fingerprints at most two bits apart, if not directly then by others as near."""
    fp, lists = F.col("fp"), []
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        o, p = (x for x in range(4) if x not in (i, j))
        lists.append(F.struct(F.lit(k).alias("k"), F.shiftleft(_group(fp, i), 16).bitwiseOR(_group(fp, j)).alias("v"), F.shiftleft(_group(fp, o), 16).bitwiseOR(_group(fp, p)).alias("rest")))
    postings = distinct.select("fp", F.inline(F.array(*lists)))
    sizes = postings.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    postings = materialise(postings.join(sizes, ["k", "v"]))
    few = postings.where(F.col("n") <= dense)
    pairs = few.select("k", "v", F.col("fp").alias("a")).join(few.select("k", "v", F.col("fp").alias("b")), ["k", "v"]).where("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(0xFF) == 0).cast("int") for i in range(8))
    direct = pairs.where((tally >= SHARED_BYTES) & (F.bit_count(x) <= MAX_BITS)).select("a", "b").distinct()
    near = F.array(F.col("rest"), *(F.col("rest").bitwiseXOR(F.lit(1 << b)) for b in range(32)))
    met = postings.where(F.col("n") > dense).select("k", "v", "fp", F.explode(near).alias("z")).groupBy("k", "v", "z").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    starred = met.select(F.explode("all").alias("a"), "b").where("a != b").distinct()
    return direct.unionByName(starred)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of each row of docs."""
    rows = materialise(fingerprints(docs.select("doc_id", "text")))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp")))
    least = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialise(least.join(by_root, "root").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
