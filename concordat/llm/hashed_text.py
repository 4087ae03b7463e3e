"""Hashed word and character n-grams of whole texts, for linear models.

Each kind of n-gram gives its share: the value of a feature is the number of its
occurrences over the number of all n-grams of that kind in the text. A linear score is
then a sum of means of weights, which needs no counting by feature, so texts of any length
are scored in one pass. An empty text has no features and gets the bias alone.

A model may add dense numbers of a text as ``EXTRA`` features after the hashed ones; they
come from a function (texts, words) -> array of shape (rows, EXTRA).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concordat.llm.shared import SLICE_BYTES, Rolling, Words, cut, give_back, ranges, slices, stored, strings, word_hashes

BITS = 16
DIM = 1 << BITS
EXTRA = 6
#: Text whose n-grams a task holds at once, or one longer text; a byte of it takes some hundred bytes of hashes.
FEATURE_BYTES = 400_000
#: Labelled rows and bytes of text that a task descends on at once; a byte takes some ten bytes of features.
PART_ROWS = 3000
PART_BYTES = 10_000_000
#: A text has at most DIM features of a kind, so a longer one takes no more memory than this many bytes.
MOST_BYTES = DIM
LEAST_OF_LABEL = 50
KEY_BITS = 1 << 25
#: Features whose weights a task averages over all parts.
BLOCK = 2048
ALL = DIM + EXTRA
SCALE = 20.0
CHARS = (3, 5)
SALTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64) | np.uint64(1)


def slot(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * SALTS[kind] >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: pa.Array, words: Words | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, row) of all n-grams, one pair of arrays for each kind; rows ascend."""
    words = words or Words(texts)
    h = word_hashes(words)
    yield slot(h, 0), words.doc
    two = words.doc[1:] == words.doc[:-1]
    yield slot(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:], 1)[two], words.doc[1:][two]
    rolling = Rolling(texts)
    for i, n in enumerate(CHARS):
        g, row = rolling.grams(n)
        yield slot(g, 2 + i), row


def scores(texts: pa.Array, weights: np.ndarray, bias: float, words: Words | None = None, extra=None) -> np.ndarray:
    out = np.full(len(texts), bias)
    words = words or Words(texts)
    if extra is not None:
        out += extra(texts, words) @ weights[DIM:]
    for f, row in features(texts, words):
        n = np.bincount(row, minlength=len(texts))
        out += SCALE * np.bincount(row, weights[f], len(texts)) / np.maximum(n, 1)
    return out


def sparse(texts: pa.Array, extra=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text."""
    f, r, v = [], [], []
    words = Words(texts)
    if extra is not None:
        f.append(np.tile(np.arange(DIM, ALL), len(texts)))
        r.append(np.repeat(np.arange(len(texts)), EXTRA))
        v.append(extra(texts, words).ravel())
    for feature, row in features(texts, words):
        key, n = np.unique(row.astype(np.int64) * DIM + feature, return_counts=True)
        row = key // DIM
        f.append(key % DIM)
        r.append(row)
        v.append(SCALE * n / np.maximum(np.bincount(row, n, len(texts)), 1)[row])
    f, r, v = map(np.concatenate, (f, r, v))
    order = np.argsort(r, kind="stable")
    cut = np.searchsorted(r[order], np.arange(1, len(texts)))
    return list(zip(np.split(f[order].astype(np.int32), cut), np.split(v[order].astype(np.float32), cut), strict=True)) if len(texts) else []


class Sample:
    """Sparse rows of one part of a table: x @ w and x.T @ c, a million values at a time."""

    STEP = 1_000_000

    def __init__(self, rows: list):
        self.n = len(rows)
        size = [len(r["f"]) // 4 for r in rows]
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.f, self.v = np.empty(self.start[-1], np.int32), np.empty(self.start[-1], np.float32)
        for i, r in enumerate(rows):
            self.f[self.start[i] : self.start[i + 1]] = np.frombuffer(r["f"], np.int32)
            self.v[self.start[i] : self.start[i + 1]] = np.frombuffer(r["v"], np.float32)
        self.y = np.array([r["y"] for r in rows], float)
        self.weight = np.array([r["weight"] for r in rows], float)
        # Runs of whole rows, about STEP values each.
        cuts = np.searchsorted(self.start, np.arange(0, self.start[-1], self.STEP), side="right") - 1
        edges = np.unique(np.append(cuts, self.n)).tolist()
        self.parts = list(zip(edges, edges[1:], strict=False))

    def values(self, i: int, j: int) -> tuple[slice, np.ndarray]:
        at = slice(self.start[i], self.start[j])
        return at, np.repeat(np.arange(i, j), np.diff(self.start[i : j + 1]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, j in self.parts:
            at, row = self.values(i, j)
            out[i:j] = np.bincount(row - i, w[self.f[at]] * self.v[at], j - i)
        return out

    def back(self, c: np.ndarray) -> np.ndarray:
        out = np.zeros(ALL)
        for i, j in self.parts:
            at, row = self.values(i, j)
            out += np.bincount(self.f[at], c[row] * self.v[at], ALL)
        return out


def likely(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is none of ``ids``, so that a join moves few texts that it drops.

    A key is a bit of ``KEY_BITS``, by hash; the bits set are a table of at most ``KEY_BITS`` / 64 rows, whatever the size of ``ids``.
    """
    h = F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    bits = ids.select(h.alias("__hash")).groupBy(F.shiftright("__hash", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__hash % 64 as int)))").alias("__bits"))
    return rows.join(F.broadcast(bits), (F.shiftright(h, 6) == F.col("__word")) & (F.getbit("__bits", (h % 64).cast("int")) == 1)).drop("__word", "__bits")


def labelled(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, label: str, seed: int) -> DataFrame:
    """id, y, text and left_out of every labelled row, as files under the shared folder; ``discard`` deletes them.

    A label that is null counts as none; of a repeated id the smaller label holds, and of rows that repeat it the smallest
    text. ``left_out`` is a quarter of the ids by their hash, for what is set on rows that the descent does not see.
    """
    spark = docs.sparkSession
    l = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and __id is not null")
    l = l.groupBy("__id").agg(F.min("y").alias("y"))
    two = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if two.schema["__id"].dataType == l.schema["__id"].dataType:
        two = likely(two, l, "__id")
    # A number of partitions of its own, as a small shuffle that Spark joins together is one task.
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = two.join(l, "__id").repartition(tasks, "__id").groupBy("__id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    return stored(one.select(F.col("__id").cast("string").alias("id"), "y", "text", (F.pmod(F.xxhash64(F.lit(seed), F.col("__id").cast("string")), F.lit(4)) == 3).alias("left_out")))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Rows to descend on and rows left out, each all rows where one of them lacks a label; None where all lack one."""
    have = {(r["left_out"], r["y"]) for r in rows.select("left_out", "y").distinct().collect()}
    if len({y for _, y in have}) < 2:
        return None
    return (rows.where("not left_out"), rows.where("left_out")) if len(have) == 4 else (rows, rows)


def learnt(rows: DataFrame, learn: Callable[[Sample], tuple[np.ndarray, float]], *, extra=None, part_rows: int = PART_ROWS, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias from every one of ``rows`` (id, y, text; both labels): ``learn`` descends on each part of them, and the parts are averaged.

    Rows are dealt by a hash of their id to as many parts as ``part_rows`` rows and ``PART_BYTES`` of text ask for, so the
    result does not depend on the cluster and a part's memory not on the table. Where a label is rare, its rows go to
    several parts, all equally often, so that each part has about ``LEAST_OF_LABEL`` of them, or all. A feature's weight
    is averaged over the parts by the number of their rows that hold it: parts that never saw it do not shrink it.
    The sums are those of Spark tasks, one for each block of features.
    """
    size = F.least(F.octet_length("text"), F.lit(MOST_BYTES)).cast("long")
    count = {r["y"]: r for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()}
    parts = max(1, *(-(-sum(r[k] for r in count.values()) // most) for k, most in (("n", part_rows), ("bytes", PART_BYTES))))
    times = {y: min(parts, -(-parts * LEAST_OF_LABEL // r["n"])) for y, r in count.items()}
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == 0, times[0]).otherwise(times[1]) - 1))
    home = F.xxhash64(F.lit(seed + 1), "id")  # not the hash that leaves rows out
    dealt = rows.select("id", "y", "text", each.alias("k")).select(F.pmod(home + F.col("k"), F.lit(parts)).cast("int").alias("part"), "id", "y", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got = None, []
        for b in slices(batches, "text", FEATURE_BYTES):
            part = b.column(0)[0].as_py()
            got += [{"f": f.tobytes(), "v": v.tobytes(), "y": y, "weight": 1.0} for (f, v), y in zip(sparse(strings(b, "text"), extra), b.column(1).to_pylist(), strict=True)]
        if not got:
            return
        sample = Sample(got)
        got.clear()
        w, bias = learn(sample)
        n = np.bincount(sample.f, minlength=ALL)
        for k, at in enumerate(range(0, ALL + 1, BLOCK)):
            own = slice(at, at + BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([np.append(w, bias)[own].tobytes()], pa.binary()), pa.array([np.append(n, sample.n)[own].astype(float).tobytes()], pa.binary())],
                ["block", "part", "w", "n"],
            )
        give_back()

    def mean(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = seen = 0.0
        for w, n in zip(t["w"], t["n"], strict=True):
            w, n = np.frombuffer(w.as_buffer()), np.frombuffer(n.as_buffer())
            total, seen = total + w * n, seen + n
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([(total / np.maximum(seen, 1)).tobytes()], pa.binary())})

    done = dealt.repartitionById(parts, "part").sortWithinPartitions("id").select("part", "y", "text").mapInArrow(fit, "block int, part int, w binary, n binary")
    blocks = sorted(done.groupBy("block").applyInArrow(mean, "block int, w binary").collect(), key=lambda r: r["block"])
    w = np.concatenate([np.frombuffer(r["w"]) for r in blocks])
    return w[:ALL], float(w[ALL])


def scored(rows: DataFrame, w: np.ndarray, b: float, *, extra=None) -> DataFrame:
    """score, bad and good: of rows (y, text), how many of each label have a score."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(batches, most=FEATURE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(texts, w, b, extra=extra))], ["y", "score"])

    each = rows.select("y", "text").mapInArrow(score, "y int, score double")
    return cut(each.groupBy("score").agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good")))


def batches_of(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for b in slices(batches, text, most):
        yield b, strings(b, text)


def descend(gradient, steps: int, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on (weights, bias); ``gradient(w, b)`` returns both parts."""
    w, b = np.zeros(ALL), 0.0
    m, s, mb, sb = np.zeros(ALL), np.zeros(ALL), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = gradient(w, b)
        g = g + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / up) / (np.sqrt(s / down) + 1e-8)
        b = b - rate * (mb / up) / (np.sqrt(sb / down) + 1e-8)
    return w, float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


__all__ = ["ALL", "DIM", "EXTRA", "FEATURE_BYTES", "PART_ROWS", "Sample", "batches_of", "descend", "features", "labelled", "learnt", "ranges", "scored", "scores", "sigmoid", "sparse", "split"]
