"""Quality rules: fixed thresholds on text counts, then a calibrated n-gram classifier.

The counts come from whole texts, exactly: words and lines are compared as strings, by
their numbers in a dictionary of the slice. The classifier is a logistic regression over
hashed word and character n-grams, fitted on all labelled rows: tasks descend on parts of
them, in which each label weighs half, and the parts' weights are averaged. A quarter of the
rows is left out to calibrate the probabilities, all of it (Platt's two parameters, at the
labels' own frequencies). Scoring runs in Arrow batches
with the fitted weights, a constant 256 KB.

Nulls: a null text is empty, has no words and fails the base rules; a null id passes
through and is never a labelled row. Without any label, or with labels of one value only,
the classifier keeps everything the base rules keep. An empty table gives an empty result.
Rows that repeat are scored each; a probability at the threshold is kept. Texts of any length
are counted and scored whole. Other columns are not read; with ``carry`` those that have the
name of a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from concordat.llm.hashed_text import ALL, FEATURE_BYTES, PART_ROWS, Sample, batches_of, descend, labelled, learnt, scored, scores, sigmoid, split
from concordat.llm.shared import Words, discard

STEPS = 60
LEAST_WORDS = 50
REPEAT_PERCENT = 50
THRESHOLD = 0.5
FOUND = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint") | {"base_failed": "boolean", "kept": "boolean", "p_quality": "double"}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def counts(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words by row."""
    n, k = len(texts), len(words.flat)
    out = {"n_words": words.n, "word_chars": np.bincount(words.doc, pc.utf8_length(words.flat).to_numpy(), n).astype(np.int64)}
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int32, n + 1, texts.offset * 4).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[np.frombuffer(data, np.uint8)[off[0] : off[-1]]])]) if data is not None and off[-1] > off[0] else np.zeros(1, np.int64)
    out["n_symbols"] = marks[off[1:] - off[0]] - marks[off[:-1] - off[0]]

    lines = pc.split_pattern(texts, "\n")
    row, flat = pc.list_parent_indices(lines).to_numpy().astype(np.int64), lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    row, code = row[full.to_numpy(zero_copy_only=False)], flat.filter(full).dictionary_encode()
    key = row * max(len(code.dictionary), 1) + code.indices.to_numpy()
    out["n_dup_lines"] = np.bincount(row, pd.Series(key).duplicated().to_numpy(), n).astype(np.int64)

    repeat = np.zeros(k, bool)
    if k >= 3:
        code = words.flat.dictionary_encode()
        size, word = np.int64(len(code.dictionary)), code.indices.to_numpy().astype(np.int64)
        inside = np.flatnonzero(words.doc[2:] == words.doc[:-2])
        # Pairs are numbered first, so that pair, word and row fit into 63 bits for any slice.
        pair = pd.factorize(word[inside] * size + word[inside + 1])[0].astype(np.int64)
        key = (pair * size + word[inside + 2]) * n + words.doc[inside]
        again = inside[pd.Series(key).duplicated(keep=False).to_numpy()]
        for i in range(3):
            repeat[again + i] = True
    out["n_repeat_words"] = np.bincount(words.doc, repeat, n).astype(np.int64)
    return out


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def learn(sample: Sample) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression on one part; each label weighs half."""
    use = np.where(sample.y == 1, 0.5 / max((sample.y == 1).sum(), 1), 0.5 / max((sample.y == 0).sum(), 1))

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        c = (sigmoid(sample.dot(w) + b) - sample.y) * use
        return sample.back(c), c.sum()

    return descend(gradient, STEPS)


def platt(found: DataFrame) -> tuple[float, float]:
    """Slope and offset of p = sigmoid(slope * margin + offset), by Newton's method over all margins with their counts (score, bad, good)."""
    z, bad, good = F.col("score"), F.col("bad"), F.col("good")
    neg, pos = found.agg(F.sum(bad), F.sum(good)).first()
    # Targets a little inside 0 and 1, as many rows as there are of each label would suggest.
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + F.exp(-(slope * z + offset)))
        g, h = good * (p - high) + bad * (p - low), (good + bad) * p * (1 - p)
        # Decimals add up to the same whatever the order.
        gz, g1, hzz, hz, h1 = (float(x) / (pos + neg) for x in found.agg(*[F.sum(e.cast("decimal(38,18)")) for e in (g * z, g, h * z * z, h * z, h)]).first())
        hess = np.array([[hzz + 1e-6, hz], [hz, h1 + 1e-6]])
        step = np.linalg.solve(hess, [gz + 1e-6 * slope, g1 + 1e-6 * offset])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)


def trained(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, label: str, part_rows: int, seed: int) -> tuple[np.ndarray, float, float, float]:
    """Weights and bias of the regression, slope and offset of the calibration."""
    rows = labelled(docs, labels, text=text, doc_id=doc_id, label=label, seed=seed)
    two = split(rows)
    if two is None:
        out = np.zeros(ALL), 30.0, 1.0, 0.0
    else:
        w, b = learnt(two[0], learn, part_rows=part_rows, seed=seed)
        out = w, b, *platt(scored(two[1], w.astype(np.float32), b))
    discard(rows)
    return out


def judge(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    part_rows: int = PART_ROWS, threshold: float = THRESHOLD, seed: int = 5, carry: bool = False,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_quality.

    With ``carry``, all columns of ``docs`` in place of doc_id, so that a filter needs no join back.
    """
    w, b, slope, offset = trained(docs, labels, text=text, doc_id=doc_id, label=label, part_rows=part_rows, seed=seed)
    w, read = w.astype(np.float32), text if carry else "__text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(batches, read, FEATURE_BYTES):
            words = Words(texts)
            c = counts(texts, words)
            wide = batch.num_columns if carry else 1
            failed = base_failed(c["n_words"], c["n_repeat_words"])
            p = sigmoid(slope * scores(texts, w, b, words) + offset)
            found = {**{k: pa.array(v, pa.int64()) for k, v in c.items()}, "base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= threshold)), "p_quality": pa.array(p)}
            yield pa.RecordBatch.from_arrays([*batch.columns[:wide], *found.values()], [*batch.schema.names[:wide], *found])

    rows = docs.select(*[c for c in docs.columns if c not in FOUND]) if carry else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    kept = rows.schema.fields[: None if carry else 1]
    return rows.mapInArrow(score, T.StructType([*kept, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in FOUND.items())).fields]))
