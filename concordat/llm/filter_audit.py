"""Interaction audit of a chain of filters: what each order of the filters would keep, remove and lose.

Every document has a mask, one bit for each filter whose failure condition it meets. A
part's documents are counted by mask, once each for all, for those labelled good and for
those labelled toxic. These histograms, stacked as rows, times an integer matrix with one
row a mask and one column an order and step give the outcome of every order at every step:
four matrices, for kept, removed, redundant and unique outcomes. With five filters a matrix
is 32 by 600. The product runs in tasks over rows of parts; a part is one row whatever its
size.

A text's copies are found by its SHA-256. They are counted by (text, part, labels) before
anything is shuffled by the text alone, so a text that a third of all documents hold is a
few rows there.

Nulls: a null text is an empty one, a null part the empty string. A document without an id
has no smaller one and is smaller than none, so it never fails as a copy. Rows that repeat
an id count each for itself and are no copies of one another. Of labels that repeat an id
one that says so is enough; labels of other values count as neither. Very long texts are
read whole, in slices that hold at least one text. An empty table gives no parts and no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from concordat.llm.shared import Words, cut, slices, strings

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_SHARE, UPPER_SHARE, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: Parts in one product of matrices.
PARTS_AT_ONCE = 256


@cache
def outcomes(filters: str = FILTERS) -> dict[str, np.ndarray]:
    """Integer matrices of 2**n rows (masks, the first filter the lowest bit) and n! * n columns (orders, then steps)."""
    n = len(filters)
    orders = np.array(list(permutations(range(n))))
    mask = np.arange(1 << n)[:, None, None]
    fails = (mask >> orders[None]) & 1
    before = np.cumsum(fails, axis=2) - fails
    each = {
        "kept": (before + fails) == 0,
        "removed": (fails == 1) & (before == 0),
        "redundant": (fails == 1) & (before > 0),
        "unique_fails": np.broadcast_to(mask == (1 << orders[None]), fails.shape),
    }
    return {k: v.reshape(1 << n, -1).astype(np.int64) for k, v in each.items()}


@cache
def columns(filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Order, step and place of the step's filter of each column of the matrices."""
    orders = list(permutations(range(len(filters))))
    names = ["".join(filters[i] for i in o) for o in orders for _ in o]
    return names, np.tile(np.arange(1, len(filters) + 1), len(orders)), np.array(orders).ravel()


def product(hist: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """Each outcome as (parts, orders and steps) from histograms of (parts, masks)."""
    m = outcomes(filters)
    out = {k: hist @ v for k, v in m.items()}
    out["good_lost"], out["toxic_lost"] = good @ m["removed"], toxic @ m["removed"]
    own = (columns(filters)[2][:, None] == np.arange(len(filters))).astype(np.int64)
    out["shapley"] = (out["removed"] @ own) @ own.T
    return out


def failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without texts, with ``mask``: the bits of the first four filters, which look at one text alone."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            t = strings(b, text)
            w = Words(t)
            code = w.flat.dictionary_encode()
            known = max(len(code.dictionary), 1)
            pair = np.unique(w.doc * known + code.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            distinct = np.bincount(pair // known, minlength=len(t))
            upper = pc.count_substring_regex(t, "[A-Z]").to_numpy().astype(np.int64)
            points = pc.utf8_length(t).to_numpy().astype(np.int64)
            fails = [w.n < FEW_WORDS, 100 * distinct < DISTINCT_SHARE * w.n, 100 * upper > UPPER_SHARE * points, pc.match_substring_regex(t, SYMBOLS).to_numpy(zero_copy_only=False)]
            mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails)).astype(np.int32)
            kept = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in kept], pa.array(mask)], names=[*kept, "mask"])

    schema = T.StructType([*[f for f in docs.schema if f.name != text], T.StructField("mask", T.IntegerType())])
    return docs.mapInArrow(measure, schema)


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of ``docs`` (doc_id, lang, text) with ``labels`` (doc_id, quality, toxic); rows of no document may occur."""
    d = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("copy_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    each = failures(d).groupBy("doc_id", "part", "copy_key", "mask").agg(F.count("*").alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id"))
    said = said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    each = each.join(said, each["doc_id"] == said["label_id"], "left")
    kind = ["copy_key", "part", "mask", "good", "toxic"]
    known = F.col("doc_id").isNotNull()
    each = each.select("doc_id", "n", "copy_key", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    groups = cut(each.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("with_id"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("least")))
    first = groups.groupBy(F.col("copy_key").alias("key")).agg(F.min("least.doc_id").alias("first_id"))
    groups = groups.join(first, F.col("copy_key") == F.col("key"), "left")
    copies = F.col("with_id") - F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), copies.alias("n")))
    rows = groups.select("part", "good", "toxic", F.inline(split))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def interactions(hist: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders and steps of each part from (part, mask, n, good, toxic)."""
    masks, counts = 1 << len(filters), ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    stacked = hist.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most one cell a mask

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, step, _ = columns(filters)
        for b in batches:
            for at in range(0, b.num_rows, PARTS_AT_ONCE):
                s = b.slice(at, PARTS_AT_ONCE)
                cells = s.column(1)
                row, flat = pc.list_parent_indices(cells).to_numpy(), cells.flatten()
                place = (row, pc.struct_field(flat, "mask").to_numpy())
                h = {c: np.zeros((s.num_rows, masks), np.int64) for c in ("n", "good", "toxic")}
                for c, m in h.items():
                    m[place] = pc.struct_field(flat, c).to_numpy()
                out = product(h["n"], h["good"], h["toxic"], filters)
                part = s.column(0).take(pa.array(np.repeat(np.arange(s.num_rows), len(orders))))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(orders * s.num_rows), pa.array(np.tile(step, s.num_rows).astype(np.int32)), *[pa.array(out[c].ravel()) for c in counts]],
                    names=["part", "filter_order", "step", *counts],
                )

    return stacked.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    return interactions(histograms(docs, labels))
