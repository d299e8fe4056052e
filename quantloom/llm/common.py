"""What the operators of this subpackage share: scratch tables, word rules, folds, packed batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are `[^\x20\x09-\x0D]+`; bytes.split() without arguments splits UTF-8 bytes at just these six characters.
WHITE = r"[\x20\x09-\x0D]+"
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Characters that numpy handles at a time; bounds a task's memory whatever the texts' lengths.
BLOCK_CHARS = 400_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"  # one machine, as in tests
    path = f"{base.rstrip('/')}/quantloom-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Within, the session has another value of a setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, texts: int):
    """Within, scans of Parquet hold few rows of texts at a time, and about `texts` bytes of them go to a Python worker."""
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(texts)), setting(spark, "spark.sql.parquet.columnarReaderBatchSize", "512"):
        yield


#: Of each passing() that we are in, the innermost last, the folders written so far.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession):
    """Tables that materialise() writes within are deleted at the end, but for those with `keep`: nothing else may be read after it."""
    folders: list[str] = []
    token = _PASSING.set((*_PASSING.get(), folders))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for f in folders:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, row_groups: int | None = None, keep: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs only a read.
    row_groups: bytes of Parquet's row groups, for tables of long binary values. keep: the table outlives the passing() that we are in.
    The shuffle files of what went before are deleted when the table is written.
    """
    spark = df.sparkSession
    folder, within = scratch_dir(spark), _PASSING.get()[: -1 if keep else None]
    if within:
        within[-1].append(folder)
    path = folder + "/t"
    out = df.write.option("compression", "zstd")
    with setting(spark, _CLEANUP, "true"):
        (out.option("parquet.block.size", row_groups) if row_groups else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the machine; workers live on after a task, and would keep it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches, column: str = "text", most: int = 2_000_000):
    """Parts of batches that hold about `most` bytes of a column of texts; a longer text is a part of its own."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
            yield b.slice(i, j - i)
            i = j


def blocks(texts: list, most: int = BLOCK_CHARS):
    """(first, last+1) of runs of texts that hold about `most` characters; a longer text is a run of its own."""
    at = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def table(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((cols[f.name], f) for f in schema)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def uniform(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) from a seeded hash of the columns; reruns agree."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)).cast("double") / F.lit(float(1 << 53))
