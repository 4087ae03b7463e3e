"""What the operators share: the shared folder, lineage cuts and Arrow text kernels.

The text kernels work on Arrow slices of a few megabytes, so a Python worker's memory
does not depend on the batch size that Spark picks; one very long text makes a slice of
its own. Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` everywhere.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master, and the warehouse a cluster.
    """
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        root = tempfile.mkdtemp(prefix="concordat-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    sc.setCheckpointDir(root)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder. Spark deletes the files with the last reference to them where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true, as ``concordat.session`` sets it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written under the shared folder as Parquet and read again, so that size estimates start anew from the files.

    The files go with ``discard``, or when the driver's session ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Gathered:
    """Tables of one schema written one after another into one folder under the shared one, to be read as one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.at)

    def table(self, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.at)


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns under private names, whatever they were called, and the private name of each."""
    names = {c: f"__column{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items()]), names


def ranges(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of at most ``most`` bytes, or of one text."""
    n = len(arr)
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i in range(n):
        if i > at and total + size[i] > most:
            yield at, i - at
            at, total = i, 0
        total += int(size[i])
    yield at, n - at


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of all batches. Workers live on between tasks, so what a batch took goes back to the system after it, not to a pool."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        for at, n in ranges(col, most):
            yield b.slice(at, n)
        del b, col
        give_back()


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def strings(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The text column as plain strings, null as empty."""
    col = batch.column(batch.schema.get_field_index(text))
    return pc.fill_null(col.cast(pa.string()), "")


class Words:
    """Words of a slice: ``flat`` (strings), ``doc`` (row of each), ``n`` (count by row), ``start``."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(texts)
        flat, doc = parts.flatten(), pc.list_parent_indices(parts)
        full = pc.greater(pc.binary_length(flat), 0)
        self.flat = flat.filter(full)
        self.doc = doc.filter(full).to_numpy().astype(np.int64)
        self.n = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])[:-1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n, kept for the worker's life up to 8 MB of text."""
    if len(POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, BASE), np.full(m, BASE_INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if m > 8_000_000:
            return up[:n], down[:n]
        POWERS["up"], POWERS["down"] = up, down
    return POWERS["up"][:n], POWERS["down"][:n]


class Rolling:
    """Hashes of any byte range of a string array's data in constant time each."""

    def __init__(self, arr: pa.Array):
        _, off, data = arr.buffers()
        off = np.frombuffer(off, np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64) if len(arr) else np.zeros(1, np.int64)
        self.off = off - off[0]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.raw = raw
        self.up, self.down = powers(len(raw) + 1)
        self.sum = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * self.up[: len(raw)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(np.uint64))

    def each(self) -> np.ndarray:
        return self.of(self.off[:-1], self.off[1:])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unmixed hashes of all n-byte windows inside a string, and the row of each."""
        size = np.maximum(self.off[1:] - self.off[:-1] - n + 1, 0)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) + np.repeat(self.off[:-1] - (np.cumsum(size) - size), size)
        return (self.sum[at + n] - self.sum[at]) * self.down[at], row


def word_hashes(words: Words) -> np.ndarray:
    """uint64 by word, hashed once for each distinct word of the slice."""
    if not len(words.flat):
        return np.zeros(0, np.uint64)
    d = words.flat.dictionary_encode()
    return Rolling(d.dictionary).each()[d.indices.to_numpy()]
