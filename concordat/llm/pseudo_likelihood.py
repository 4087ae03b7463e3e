"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words before and the two after it. A word is one of
2**BITS codes, by hash; its class is the first of WIDE * WIDE parts of the hash. Each neighbour
adds the embedding of its class at its distance, a tanh follows, and the class is predicted
in two steps of WIDE outputs: its group, then its place in the group. Inside the class a
word has its share of the class's words in the whole corpus, so frequent and rare words of
one class differ, and all codes together sum to one. A document's score is the sum of the
log-probabilities of all its words.

Training covers every word of the corpus once, in ``ROUNDS`` rounds over documents dealt by
a hash of id and text. In a round each task starts from the same weights and descends over
its own rows, in the order of their hashes, in numpy (Adagrad, fixed batches); the tasks'
weights are averaged by words in a tree of groups of ``FAN``, and the next round starts
from that average. Rows are dealt to about one task for each ``TASK_BYTES`` of text, so the
weights depend on the table, not on the cluster, and a task that is run again gives the
same. Each task also gives the counts of the codes it met, which Spark adds up: what is
gathered grows with the words of the corpus, up to one count for each code.

Nulls: a null text is empty; a text without words has log_prob 0 and no mean. A corpus
without words is scored by the initial weights, near uniform, and a word that the training
corpus lacks counts as seen once. Texts of any length are read whole, a slice at a time.
Empty tables give an empty result. Rows that repeat are trained on and scored each; equal
texts score alike. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concordat.llm.hashed_text import batches_of
from concordat.llm.shared import Words, cut, word_hashes

WIDE = 32
CODES = WIDE * WIDE
BITS = 22
DEPTH = 16
SIDES = (-2, -1, 1, 2)
BATCH = 8192
RATE = np.float32(0.15)
FAN = 32
ROUNDS = 3
TASK_BYTES = 16_000_000
SHAPES = {"e": (len(SIDES), CODES + 1, DEPTH), "g": (DEPTH, WIDE), "gb": (WIDE,), "p": (WIDE, DEPTH, WIDE), "pb": (WIDE, WIDE)}


def initial(seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.3 if k == "e" else 0.1 if k in "gp" else 0.0, s) for k, s in SHAPES.items()]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].reshape(s), at + n
    return out


def exps(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """exp of the outputs. |tanh| <= 1 bounds them by the weights; only outputs that could overflow are shifted first."""
    z = x @ weights
    z += bias
    if np.abs(weights).sum(axis=0).max() + np.abs(bias).max() > 60:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def codes(words: Words) -> np.ndarray:
    return (word_hashes(words) >> np.uint64(64 - BITS)).astype(np.int64)


def contexts(words: Words, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words, and of their neighbours (CODES beyond the text's ends), one row a side."""
    code = code >> (BITS - (CODES.bit_length() - 1))
    at = np.arange(len(code)) + 2 * words.doc + 2
    padded = np.full(len(code) + 2 * len(words.n) + 4, CODES, np.int16)  # int16 sorts by radix
    padded[at] = code
    return code, np.stack([padded[at + s] for s in SIDES])


def hidden(w: dict, near: np.ndarray) -> np.ndarray:
    h = w["e"][0].take(near[0].astype(np.intp), axis=0, mode="clip")
    for s in range(1, len(SIDES)):
        h += w["e"][s].take(near[s].astype(np.intp), axis=0, mode="clip")
    return np.tanh(h, out=h)


def by_group(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted array."""
    edge = np.searchsorted(group, np.arange(WIDE + 1))
    for g in range(WIDE):
        if edge[g] < edge[g + 1]:
            yield g, slice(edge[g], edge[g + 1])


def log_probs(w: dict, code: np.ndarray, near: np.ndarray) -> np.ndarray:
    out = np.empty(len(code), np.float32)
    for at in range(0, len(code), BATCH):
        c = code[at : at + BATCH]
        group = (c >> (WIDE.bit_length() - 1)).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        group, place = group[order], (c & (WIDE - 1))[order]
        h = hidden(w, near[:, at : at + BATCH][:, order])
        z = exps(h, w["g"], w["gb"])
        lp = z[np.arange(len(c)), group] / z.sum(axis=1)
        for g, rows in by_group(group):
            z = exps(h[rows], w["p"][g], w["pb"][g])
            lp[rows] *= z[np.arange(len(z)), place[rows]] / z.sum(axis=1)
        out[at + order] = np.log(np.maximum(lp, np.float32(1e-37)))
    return out


class Trainer:
    def __init__(self, start: np.ndarray):
        self.flat, self.sum = start.copy(), np.full(len(start), 1e-3, np.float32)
        self.grad = np.zeros_like(start)
        self.w, self.g, self.words = views(self.flat), views(self.grad), 0

    def step(self, code: np.ndarray, near: np.ndarray) -> None:
        w, d, n = self.w, self.g, len(code)
        group = (code >> (WIDE.bit_length() - 1)).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        group, place, near = group[order], (code & (WIDE - 1))[order], near[:, order]
        h = hidden(w, near)
        self.grad[:] = 0
        z = exps(h, w["g"], w["gb"])
        z *= 1 / (n * z.sum(axis=1, keepdims=True))
        z[np.arange(n), group] -= 1 / n
        d["g"][:], d["gb"][:] = h.T @ z, z.sum(axis=0)
        dh = z @ w["g"].T
        for g, rows in by_group(group):
            x = h[rows]
            z = exps(x, w["p"][g], w["pb"][g])
            z *= 1 / (n * z.sum(axis=1, keepdims=True))
            z[np.arange(len(z)), place[rows]] -= 1 / n
            d["p"][g], d["pb"][g] = x.T @ z, z.sum(axis=0)
            dh[rows] += z @ w["p"][g].T
        dh *= 1 - h * h
        for s in range(len(SIDES)):
            by = np.argsort(near[s], kind="stable")
            key = near[s][by]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            d["e"][s][key[first]] = np.add.reduceat(dh[by], first, axis=0)
        self.sum += self.grad * self.grad
        self.flat -= RATE * self.grad / np.sqrt(self.sum)
        self.words += n

    def learn(self, code: np.ndarray, near: np.ndarray) -> None:
        for at in range(0, len(code), BATCH):
            self.step(code[at : at + BATCH], near[:, at : at + BATCH])


def average(rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, int]:
    total, words = np.zeros(sum(int(np.prod(s)) for s in SHAPES.values())), 0
    for flat, n in rows:
        total += np.frombuffer(flat, np.float32).astype(float) * n
        words += n
    return (total / max(words, 1)).astype(np.float32), words


class Model:
    """Weights of the network, and the logarithm of each code's share in its class."""

    def __init__(self, flat: np.ndarray, slots: np.ndarray | None = None, counts: np.ndarray | None = None):
        n = np.ones(1 << BITS)  # a code that was not met counts as met once
        if slots is not None and len(slots):
            n[slots] = counts
        n = n.reshape(CODES, -1)
        self.flat, self.inside = flat, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32).ravel()


def train(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> Model:
    t = F.col(text).cast("string")
    rows = docs.select(t.alias("text"), F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), t).alias("h"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-size // (ROUNDS * TASK_BYTES)))
    shape = "part bigint, flat binary, words bigint, slots array<int>, counts array<bigint>"

    def learner(start: np.ndarray):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer, seen = Trainer(start), np.zeros(1 << BITS, np.int64)
            for _, texts in batches_of(batches):
                words = Words(texts)
                code = codes(words)
                trainer.learn(*contexts(words, code))
                np.add.at(seen, code, 1)
            slots = np.flatnonzero(seen)
            if len(slots):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([trainer.flat.tobytes()], pa.binary()), pa.array([trainer.words], pa.int64()), pa.array([slots], pa.list_(pa.int32())), pa.array([seen[slots]], pa.list_(pa.int64()))],
                    ["part", "flat", "words", "slots", "counts"],
                )

        return learn

    def join(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        flat, n = average(list(zip(t["flat"].to_pylist(), t["words"].to_pylist(), strict=True)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "flat": pa.array([flat.tobytes()], pa.binary()), "words": pa.array([n], pa.int64())})

    flat, met = initial(seed), None
    for turn in range(ROUNDS):
        dealt = rows.where(F.pmod("h", F.lit(ROUNDS)) == turn).repartition(tasks, F.col("h")).sortWithinPartitions("h")
        done = cut(dealt.select("text").mapInArrow(learner(flat), shape))
        count = done.select(F.explode(F.arrays_zip("slots", "counts")).alias("c")).select(F.col("c.slots").alias("slot"), F.col("c.counts").alias("n"))
        met = count if met is None else met.unionByName(count)
        parts = done.select("part", "flat", "words")
        while parts.count() > FAN:
            group = F.floor(F.col("part") / FAN)
            parts = cut(parts.withColumn("group", group).groupBy("group").applyInArrow(join, "part bigint, flat binary, words bigint"))
        sets = sorted(parts.collect(), key=lambda r: r["part"])
        flat = average([(r["flat"], r["words"]) for r in sets])[0] if sets else flat
    met = met.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    return Model(flat, met["slot"].to_numpy(), met["n"].to_numpy())


def score(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum over all words) and mean_log_prob (null without words)."""
    flat, inside = model.flat, model.inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = views(flat)
        for b, texts in batches_of(batches):
            words = Words(texts)
            code = codes(words)
            lp = log_probs(w, *contexts(words, code)) + inside[code]
            total = np.bincount(words.doc, lp, len(texts))
            mean = pa.array(total / np.maximum(words.n, 1), mask=words.n == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.n), pa.array(total), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    two = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, log_prob double, mean_log_prob double")


def pseudo_likelihood(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """Train on ``docs`` and score them."""
    return score(docs, train(docs, text=text, doc_id=doc_id, seed=seed), text=text, doc_id=doc_id)
