"""Quality classifier by Bradley-Terry pairwise ranking.

Documents marked 1 are preferred to documents marked 0. The model scores a document by a
linear function of its hashed n-grams and of six shares of the text, and the odds that one is preferred over another are
the exponential of their scores' difference. All labelled rows are dealt to parts; a task
descends the logistic loss of all pairs of its part, and the parts' weights are averaged.
Nothing else is learnt from: the label, language, source and id of a document are no input
of its score.

The scores become a verdict at a quantile: the score below which the share of documents
lies that the training labels call 0, taken over the quarter of the training rows that the
descent leaves out, all of them. Scores are then mapped to (0, 1) so that this quantile is 0.5.

Nulls: a null text is empty; a null id is hashed as the empty string and never labelled. Without both labels the
score of every text is 0.5. Empty tables give an empty result. Rows that repeat are scored
each. Equal texts have equal scores; a score at the quantile is predicted 1. Texts of any
length are scored whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from concordat.llm.hashed_text import ALL, FEATURE_BYTES, PART_ROWS, Sample, batches_of, descend, labelled, learnt, scored, scores, sigmoid, split
from concordat.llm.quality_rules import counts
from concordat.llm.shared import Words, discard

STEPS = 80
#: Pairs whose losses a task holds at once.
PAIRS = 1_000_000
BINS = 1000
FOLDS, HELD = 3, 1
#: Shares of repetition weigh most and length least, as steps of the descent are of one size for all features. Chosen on training rows left
#: out of the descent (folds 0 and 2): of 469 at most 0 came out wrong, as with 10 throughout, 2 with 3, 5 with 1.
SHAPE_SCALE = np.array([10.0, 10.0, 3.0, 10.0, 3.0, 1.0])


def shape(texts: pa.Array, words: Words) -> np.ndarray:
    """Repeated words, repeated lines, symbols and distinct words as shares, letters a word, and length on a log scale."""
    c = counts(texts, words)
    n = np.maximum(c["n_words"], 1)
    code = words.flat.dictionary_encode()
    key = words.doc * max(len(code.dictionary), 1) + code.indices.to_numpy()
    distinct = np.bincount(words.doc, ~pd.Series(key).duplicated().to_numpy(), len(texts))
    columns = (c["n_repeat_words"] / n, c["n_dup_lines"] / n, c["n_symbols"] / n, distinct / n, c["word_chars"] / n / 10, np.log1p(c["n_words"]) / 10)
    return np.stack(columns, axis=1) * SHAPE_SCALE


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def learn(sample: Sample, use: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights that rank the rows marked 1 over those marked 0, by the loss of all pairs; no bias."""
    use = np.ones(sample.n, bool) if use is None else use
    better, worse = np.flatnonzero(use & (sample.y == 1)), np.flatnonzero(use & (sample.y == 0))
    if not len(better) or not len(worse):
        return np.zeros(ALL), 0.0
    step = max(PAIRS // len(worse), 1)

    def gradient(w: np.ndarray, _: float) -> tuple[np.ndarray, float]:
        s = sample.dot(w).astype(np.float32)
        out = np.zeros(sample.n)
        for at in range(0, len(better), step):
            i = better[at : at + step]
            lost = sigmoid(s[worse] - s[i][:, None])
            out[i] -= lost.sum(axis=1, dtype=float)
            out[worse] += lost.sum(axis=0, dtype=float)
        return sample.back(out / (len(better) * len(worse))), 0.0

    return descend(gradient, STEPS)


def fit(sample: Sample) -> tuple[np.ndarray, float, float]:
    """Weights, the score at the quantile, and the spread of scores about it, for rows in memory: every fourth is left out of the descent."""
    if len(np.unique(sample.y)) < 2:
        return np.zeros(ALL), 0.0, 1.0
    check = np.arange(sample.n) % 4 == 3
    if len(np.unique(sample.y[check])) < 2 or len(np.unique(sample.y[~check])) < 2:
        check[:] = False
    w, _ = learn(sample, ~check)
    at = check if check.any() else ~check
    s, y, weight = sample.dot(w)[at], sample.y[at], sample.weight[at]
    order = np.argsort(s, kind="stable")
    s, y, weight = s[order], y[order], weight[order]
    share = weight[y == 0].sum() / weight.sum()
    # The quantile of that share: between the last score that fills it and the next.
    k = int(np.searchsorted(np.cumsum(weight) / weight.sum(), share - 1e-9)) + 1
    cut = (s[k - 1] + s[min(k, len(s) - 1)]) / 2
    spread = np.average(np.abs(s - cut), weights=weight) / 3 or 1.0
    return w, float(cut), float(spread)


def quantile(found: DataFrame) -> tuple[float, float]:
    """The score at the quantile and the spread of scores about it, exactly, from all scores with their counts (score, bad, good)."""
    n = F.col("bad") + F.col("good")
    lo, hi, rows, rank = found.agg(F.min("score"), F.max("score"), F.sum(n), F.sum("bad")).first()
    before = 0
    while lo < hi:  # the bin that holds the rank becomes the range of the next turn
        at = F.least(F.floor((F.col("score") - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
        bins = found.where(F.col("score").between(lo, hi)).groupBy(at.alias("at")).agg(F.sum(n).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: r["at"]):
            if before + r["n"] >= rank:
                lo, hi = r["lo"], r["hi"]
                break
            before += r["n"]
    upto, after = found.agg(F.sum(F.when(F.col("score") <= lo, n)), F.min(F.when(F.col("score") > lo, F.col("score")))).first()
    cut = (lo + (lo if upto > rank or after is None else after)) / 2
    # Decimals add up to the same whatever the order.
    spread = found.agg(F.sum((F.abs(F.col("score") - cut) * n).cast("decimal(38,18)"))).first()[0]
    return float(cut), float(spread) / rows / 3 or 1.0


def trained(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, label: str, part_rows: int, seed: int) -> tuple[np.ndarray, float, float]:
    """What ``fit`` gives for rows in memory, from all labelled rows of a table."""
    rows = labelled(docs, labels, text=text, doc_id=doc_id, label=label, seed=seed)
    two = split(rows)
    if two is None:
        out = np.zeros(ALL), 0.0, 1.0
    else:
        w, _ = learnt(two[0], learn, extra=shape, part_rows=part_rows, seed=seed)
        out = w, *quantile(scored(two[1], w.astype(np.float32), 0.0, extra=shape))
    discard(rows)
    return out


def rank(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", part_rows: int = PART_ROWS, seed: int = 11,
) -> DataFrame:
    """doc_id, held_out, score in [0, 1] and predicted (1 where the score is at least 0.5)."""
    w, cut, spread = trained(docs, labels.where(~held_out(F.col("doc_id"))), text=text, doc_id=doc_id, label=label, part_rows=part_rows, seed=seed)
    w = w.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(batches, most=FEATURE_BYTES):
            p = sigmoid((scores(texts, w, 0.0, extra=shape) - cut) / spread)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    three = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return three.mapInArrow(score, f"doc_id {three.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
