"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers are its runs of five words, each labelled with its occurrence number,
so a repeated run counts as often as it stands. For each of ``SKETCHES`` seeded orders the
``DRAWN`` smallest labelled k-mers are taken and hashed in the order in which they stand in
the text: two documents agree in a sketch with a probability that falls with edit
similarity, not only with overlap. Documents of fewer than five words have one k-mer, the
whole text.

Two documents are near-duplicates if the edit distance of their sequences of words (as
hashes of 32 bits) is at most (1 - similarity) times the longer one's length. Alignment runs inside the band that
this allows; a length bound and a multiset bound reject first, and all three are exact.
Classes are the connected components of the verified links.

Equal texts collapse first and are one node, named in the result by the smallest doc_id.
Equal sketches make a bucket. Candidates of a bucket are its members against one leader,
the first in one order of all nodes, so that the buckets of a group of copies share their
leader and a bucket of n members gives n - 1 pairs, whatever its size. Members that these
links leave outside their leader's component meet all others of the bucket, block against
block, as hashed words; pairs of different components that the words in common leave possible
are aligned, once however many buckets they share. So a bucket gives the components that all
its pairs would give.

Nulls: a null, empty or wordless text is a class of its own, and so is a row with a null
doc_id. Ids keep their type. Each row is judged by its own text: rows that repeat an id and
a text stay or go together. Of equal texts the smallest id stays, on ties all rows that have
it. Empty tables give an empty result. Columns beside the id and the text are not read,
whatever their names. Texts of any length are read whole; a task holds one slice of texts,
or two blocks of a bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from concordat.llm.components import components
from concordat.llm.shared import Words, cut, mix, ranges, shared_dir, slices, strings, word_hashes

SHINGLE = 5
SKETCHES = 48
DRAWN = 2
BLOCK = 2048
BITS = 2048
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
RNG = np.random.default_rng(20240607)
SEEDS = RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
FACTORS = RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: Words, hashes: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers with their occurrence numbers, and the row of each, in text order."""
    n = words.n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) + np.repeat(words.start - (np.cumsum(count) - count), count)
    size = np.minimum(n, k)[row]
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    short = (size < k).any()
    for i in range(k):
        part = padded[at + i] * np.uint64(0x9E3779B97F4A7C15)
        if short:
            part = np.where(i < size, part, np.uint64(0))
        h = (h + part) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    h = mix(h + size.astype(np.uint64))
    # Only repeated k-mers need a number; the rest keep 0.
    key = h ^ mix(row.astype(np.uint64) + np.uint64(1))
    again = pd.Series(key).duplicated().to_numpy()
    if again.any():
        pos = np.flatnonzero(again)
        occ = pd.Series(key[pos]).groupby(key[pos]).cumcount().to_numpy() + 1
        h[pos] = mix(h[pos] + occ.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, row


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words by row, SKETCHES hashes by row)."""
    words = Words(texts)
    h, row = shingles(words, word_hashes(words))
    out = np.zeros((len(texts), SKETCHES), np.uint64)
    count = np.bincount(row, minlength=len(texts))
    few = (count > 0) & (count <= DRAWN)
    if few.any():  # all of them are drawn
        mine = few[row]
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        acc = np.zeros(len(texts), np.uint64)
        for i in range(DRAWN):
            have = few & (count > i)
            acc[have] = mix(acc[have] * np.uint64(31) + h[first[have] + i])
        out[few] = mix(acc[few][:, None] + np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        h, row, count = h[~mine], row[~mine], np.where(few, 0, count)
    rows = np.flatnonzero(count)
    if len(rows):
        count = count[rows]
        start = np.concatenate([[0], np.cumsum(count)])[:-1]
        for j in range(SKETCHES):
            g = (h ^ SEEDS[j]) * FACTORS[j]
            g ^= g >> np.uint64(32)
            drawn = np.empty((DRAWN, len(rows)), np.int64)
            for i in range(DRAWN):
                least = np.minimum.reduceat(g, start)
                at = np.flatnonzero(g == np.repeat(least, count))
                if len(at) != len(rows):  # two k-mers of a text with one value: the first
                    own = np.searchsorted(start, at, side="right") - 1
                    at = at[np.concatenate([[True], own[1:] != own[:-1]])]
                drawn[i] = at
                g[at] = TOP
            drawn.sort(axis=0)
            acc = np.full(len(rows), np.uint64(j + 1))
            for i in range(DRAWN):
                acc = mix(acc * np.uint64(31) + h[drawn[i]])
            out[rows, j] = acc
    return words.n, out


def within(a: list, b: list, k: int) -> bool:
    """Whether the edit distance of two sequences is at most k, by alignment inside the band of diagonals |d| <= k.

    A column of the band is two integers of 2k + 1 bits: where the distance grows, and where it falls, from one row
    to the next (bit-parallel alignment after Myers and Hyyro). The longer sequence stands for the rows.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > k:
        return False
    if n <= k:
        return True
    rows: dict = {}
    for r, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << r
    mask, top = (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    up, down, dist = mask ^ ((1 << k) - 1), 0, k
    most, last = k + m - (n - k), top >> 1
    for i, x in enumerate(b):
        hit = rows.get(x, 0)
        hit = (hit >> (i - k) if i >= k else hit << (k - i)) & mask
        same = ((((hit & up) + up) ^ up) | hit | down) & mask
        grows, falls = down | (mask & ~(same | up)), same & up
        if i < n - k:  # along the band's lowest diagonal
            dist += not same & top
            if dist > most:
                return False
        else:  # along the last row
            dist += bool(grows & last) - bool(falls & last)
            last >>= 1
        same >>= 1
        up, down = falls | (mask & ~(same | grows)), same & grows
    return dist <= k


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """1 - edit distance / longer length >= similarity, exactly."""
    k = allowed(max(len(a), len(b)), similarity)
    if abs(len(a) - len(b)) > k:
        return False
    m = min(len(a), len(b))
    differ = a[:m] != b[:m]
    head = int(differ.argmax()) if differ.any() else m
    a, b, m = a[head:], b[head:], m - head
    differ = a[len(a) - m :] != b[len(b) - m :]
    tail = int(differ[::-1].argmax()) if differ.any() else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= k:
        return True
    _, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    surplus = np.bincount(inv[: len(a)], minlength=inv.max() + 1) - np.bincount(inv[len(a) :], minlength=inv.max() + 1)
    if max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()) > k:
        return False
    return within(inv[: len(a)].tolist(), inv[len(a) :].tolist(), k)


def allowed(longer: int | np.ndarray, similarity: float) -> int | np.ndarray:
    return ((1 - similarity) * longer + 1e-9).astype(np.int64) if isinstance(longer, np.ndarray) else int((1 - similarity) * longer + 1e-9)


def sequences(texts: pa.Array) -> list[np.ndarray]:
    """The hashed words of each text, in order."""
    words = Words(texts)
    return np.split(word_hashes(words), words.start[1:]) if len(texts) else []


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, words): the text as hashes of 32 bits of its words."""
    for b in slices(batches, "text"):
        words = [(x >> np.uint64(32)).astype("<u4").tobytes() for x in sequences(strings(b, "text"))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], ["node", "words"])


def unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(words, "<u4")


def marks(seq: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps of the words of each sequence, numbered where they repeat, and how many words share a bit with another."""
    n = np.array([len(x) for x in seq])
    row, h = np.repeat(np.arange(len(seq)), n), np.concatenate(seq).astype(np.uint64)
    again = pd.Series(h ^ (row.astype(np.uint64) << np.uint64(40))).groupby(h ^ (row.astype(np.uint64) << np.uint64(40))).cumcount().to_numpy().astype(np.uint64)
    out = np.zeros((len(seq), BITS), np.float32)
    out[row, (mix(h * np.uint64(31) + again) % np.uint64(BITS)).astype(np.int64)] = 1
    return out, n - out.sum(axis=1)


def possible(one: tuple, two: tuple, n_one: np.ndarray, n_two: np.ndarray, part_one: np.ndarray, part_two: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of positions of different parts that may be within the distance: words in common are at most bits in common and words that share a bit."""
    for at in range(0, len(n_one), 256):
        some = slice(at, at + 256)
        longer = np.maximum(n_one[some, None], n_two[None, :])
        least = longer - allowed(longer, similarity)
        common = one[0][some] @ two[0].T + np.minimum(one[1][some, None], two[1][None, :])
        i, j = np.nonzero((np.minimum(n_one[some, None], n_two[None, :]) >= least) & (common >= least) & (part_one[some, None] != part_two[None, :]))
        yield from zip((i + at).tolist(), j.tolist(), strict=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again. Size estimates start anew from the files: those of ``cut`` multiply
    in every join, and after two runs of components planning takes longer than the work."""
    at = f"{shared_dir(df.sparkSession)}/links-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def text_keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), text), F.xxhash64(text, F.lit(2), F.length(text))


def judged(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), class_id, copies and kept for every row."""
    t = F.col(text).cast("string")
    t1, t2 = text_keys(t)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), t1.alias("t1"), t2.alias("t2"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, s = sketches(strings(b, "text"))
            flat = pa.array(s.ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SKETCHES), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n), lists], ["doc_id", "t1", "t2", "words", "sketch"])

    all_ = cut(keyed.mapInArrow(sketch, f"doc_id {kind}, t1 bigint, t2 bigint, words bigint, sketch array<bigint>"))
    nodes = all_.where("doc_id is not null and words > 0").groupBy("t1", "t2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("sketch").alias("sketch")
    )
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    member = nodes.select("node", F.explode("sketch").alias("bucket"))
    # Buckets of one member go here, after a partial minimum.
    lead = member.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("high")).where("leader < high").drop("high")
    pairs = cut(member.join(lead, "bucket").where("node <> leader"))
    words = nodes.select("node", "words")
    near = pairs.select("node", "leader").distinct().join(words, "node").join(words.select(F.col("node").alias("leader"), F.col("words").alias("leader_words")), "leader")
    room = F.floor((1 - similarity) * F.greatest("words", "leader_words") + 1e-9)
    near = near.where(F.abs(F.col("words") - F.col("leader_words")) <= room).select("node", F.col("leader").alias("other"))
    near = cut(near)

    wanted = pairs.select("node").union(pairs.select(F.col("leader").alias("node"))).distinct()
    wanted = wanted.join(nodes.select("node", F.col("rep").alias("doc_id"), "t1", "t2"), "node")
    # A row that stands often gives its text once.
    texts = keyed.join(wanted, ["doc_id", "t1", "t2"]).groupBy("doc_id", "t1", "t2").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    # From here on texts are their hashed words.
    known = cut(texts.select("node", "text").mapInArrow(hashed, "node bigint, words binary"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words"):
            for at, n in ranges(b.column(3)):
                part = b.slice(at, n)
                both = zip(*(column.to_pylist() for column in part.columns[2:]), strict=True)
                ok = pa.array([similar(unpacked(x), unpacked(y), similarity) for x, y in both], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["node", "other"])

    two = near.join(known, "node").join(known.select(F.col("node").alias("other"), F.col("words").alias("partner")), "other")
    good = cut(two.select("node", "other", "words", "partner").mapInArrow(verify, "node bigint, other bigint"))
    comp = stored(components(good, "node", "other"))

    def unresolved() -> DataFrame:
        """(bucket, node, part, out) of the members but the leader of buckets where a member is outside its leader's component."""
        part = comp.withColumnRenamed("component", "part")
        placed = pairs.join(part, "node", "left").join(part.select(F.col("node").alias("leader"), F.col("part").alias("leader_part")), "leader", "left")
        own = F.coalesce("part", "node")
        placed = cut(placed.select("bucket", "node", own.alias("part"), (own != F.coalesce("leader_part", "leader")).alias("out")))
        # Pairs of one component connect nothing.
        mixed = placed.groupBy("bucket").agg(F.max("out").alias("some"), F.min("part").alias("low"), F.max("part").alias("high")).where("some and low <> high")
        return cut(placed.join(mixed.select("bucket"), "bucket"))

    placed = unresolved()
    if not placed.isEmpty():
        good = cut(good.union(rest_links(placed, known, similarity)))
        comp = stored(components(good, "node", "other"))

    named = nodes.select("t1", "t2", "node", "rep", "copies").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("class"))
    named = cut(named.join(least, "component").select("t1", "t2", "copies", "class"))
    # Copies of one text meet their class here; both sides are tables, so a hot text can be split.
    usable = F.col("doc_id").isNotNull() & (F.col("words") > 0)
    found = all_.select("doc_id", F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.when(usable, F.col("t1")).alias("t1"), "t2").join(named, ["t1", "t2"], "left")
    class_id = F.coalesce("class", "doc_id")
    return found.select(
        "doc_id", F.col("k1").alias("t1"), F.col("k2").alias("t2"), class_id.alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"),
    )


def rest_links(placed: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(node, other): links that connect what all pairs of each bucket would, from (bucket, node, part, out).

    Members are dealt to blocks and move as hashed words. A block pair is filtered at once by words in common, then
    aligned where the two are not connected yet. A pair that meets in several buckets is looked at in the first of them.
    """

    own = placed.groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    many = lambda c: F.ceil(F.count_if(c) / F.lit(float(BLOCK))).cast("int")
    size = placed.groupBy("bucket").agg(many(F.lit(True)).alias("all"), many(F.col("out")).alias("outs"), many(~F.col("out")).alias("ins"))
    h = F.xxhash64("node")
    split = F.col("all") > 1
    mine = F.when(split & F.col("out"), F.pmod(h, "outs")).when(split, F.col("outs") + F.pmod(h, "ins")).otherwise(0).cast("int")
    # A bucket of one block meets itself. Beyond that, a block of outside members meets all blocks, one of the others the outside ones.
    last = F.when(~split, 0).when(F.col("out"), F.col("outs") + F.col("ins") - 1).otherwise(F.col("outs") - 1)
    tiles = placed.join(size, "bucket").withColumn("mine", mine).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    tiles = tiles.select("bucket", F.least("mine", "k").alias("i"), F.greatest("mine", "k").alias("j"), "mine", "node", "part")

    def block(t: pa.Table) -> pa.Table:
        node, mine, i, bucket = t["node"].to_numpy(), t["mine"].to_numpy(), t["i"][0].as_py(), t["bucket"][0].as_py()
        seq, buckets = [unpacked(x) for x in t["words"].to_pylist()], [set(x) for x in t["buckets"].to_pylist()]
        n, comp = np.array([len(x) for x in seq]), np.unique(t["part"].to_numpy(), return_inverse=True)[1]
        left = np.flatnonzero(mine == i)
        right = np.flatnonzero(mine != i) if (mine != i).any() else left
        one = marks([seq[x] for x in left])
        two = one if right is left else marks([seq[y] for y in right])
        a, b = [], []
        for p, q in possible(one, two, n[left], n[right], comp[left], comp[right], similarity):
            x, y = left[p], right[q]
            if comp[x] != comp[y] and min(buckets[x] & buckets[y]) == bucket and similar(seq[x], seq[y], similarity):
                comp[comp == comp[y]] = comp[x]
                a.append(node[x]), b.append(node[y])
        return pa.table({"node": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64())})

    return cut(tiles.join(cut(known.join(own, "node")), "node").groupBy("bucket", "i", "j").applyInArrow(block, "node bigint, other bigint"))


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), copies (rows with this very text), kept, for every row."""
    return judged(docs, text=text, doc_id=doc_id, similarity=similarity).drop("t1", "t2")
