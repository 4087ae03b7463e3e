"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned onto the principal axes of all vectors, the
leading axis first; the turn keeps inner products. Equal vectors of one label collapse to
one representative with a count, so a vector that a third of the rows hold is one row.

A label that fits one task is compared there. Beyond that, space is split by a tree over
the leading axes and the norm of what lies beyond them: each node is cut at a median on the
axis of most variance. Two unit vectors with cosine at or over the threshold lie within
sqrt(2 - 2 threshold) of each other, so a vector has its home in one leaf and visits those
other leaves whose box is that near, on the upper side of the cut that parts them only: a
pair meets in one leaf, once. The splits come from at most ``SAMPLE`` vectors; any splits
give the same links. Leaves that still hold more than a task should are split into blocks,
and a tile is a pair of blocks, so every group is bounded. A vector moves once for its home,
once for each leaf it visits, and once for each block of a leaf that space cannot part.

In a tile the inner product is accumulated over growing runs of leading axes; a pair stays
only while the sum so far plus the product of the two suffix norms can reach the threshold,
and parts of a tile whose boxes are too far apart are skipped. What stays is decided by the
cosine of the original vectors in double precision.

A tile returns, for each vector, how many links it has there, and only so many links as
connect the tile's vectors, never all pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and vectors
with a null label, link with nothing. Vectors of different lengths never link. Rows that
repeat a vec_id are vectors of their own: they link like any two equal vectors (one link
each), and each of the rows is returned. A cosine equal to the threshold is a link. Very
long vectors make smaller blocks, and only their first ``TURNED`` coordinates are turned. Columns beside the three are not read, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concordat.llm.components import components, spanning
from concordat.llm.shared import cut

#: Bytes of one block of vectors in doubles.
BLOCK_BYTES = 1 << 24
SAMPLE = 20_000
AXES = 24
DEPTH = 14
#: Longer vectors have only so many of their coordinates turned; any orthogonal turn gives the same links.
TURNED = 1024
PART = 1024
STEPS = (16, 32)
#: Room for rounding in the bounds, far over the error of sums of products of unit vectors in doubles.
SLACK = 1e-9


def block_rows(d: int) -> int:
    return max(256, BLOCK_BYTES // (8 * d))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow or underflow on the way."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, unit rows) of an array of lists."""
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, unit(flat[at[rows][:, None] + np.arange(d)])


def axes(usable: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes, by vector length, from the second moments of all unit vectors (at most TURNED x TURNED numbers a task)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in by_length(b.column(0)):
                x = x[:, :TURNED]
                total[d] = total.get(d, 0) + x.T @ x
        yield pa.RecordBatch.from_pydict({"d": pa.array(list(total), pa.int32()), "m": pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64()))})

    parts = usable.select("v").mapInArrow(moments, "d int, m array<double>")
    sums = parts.select("d", F.posexplode("m")).groupBy("d", "pos").agg(F.sum("col").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in sums.toLocalIterator():
        d, k = r["d"], min(r["d"], TURNED)
        out.setdefault(d, np.zeros((k, k)))[r["pos"] // k, r["pos"] % k] = r["x"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in out.items()}


def turn_by(x: np.ndarray, axes_: np.ndarray) -> np.ndarray:
    k = len(axes_)
    return x @ axes_ if k == x.shape[1] else np.concatenate([x[:, :k] @ axes_, x[:, k:]], axis=1)


def leading(turned: np.ndarray, k: int) -> np.ndarray:
    """The first k axes and the norm of the rest: inner products of these are never under those of the vectors."""
    return np.concatenate([turned[:, :k], np.sqrt(np.maximum(0, (turned[:, k:] ** 2).sum(axis=1, keepdims=True)))], axis=1)


class Tree:
    """Binary splits of space: node n has children ``down[n]`` and ``down[n] + 1``, or is a leaf (-1)."""

    def __init__(self, points: np.ndarray | None, share: float):
        self.axis, self.cut, self.down = [0], [0.0], [-1]
        todo = [(0, np.arange(len(points)), 0, 1.0)] if points is not None else []
        while todo:
            n, mine, depth, part = todo.pop()
            if depth == DEPTH or part <= share or len(mine) < 16:
                continue
            p = points[mine]
            axis = int(p.std(axis=0).argmax())
            at = float(np.median(p[:, axis]))
            right = p[:, axis] >= at
            if right.all() or not right.any():
                continue
            self.axis[n], self.cut[n], self.down[n] = axis, at, len(self.down)
            for side in (~right, right):
                todo.append((len(self.down), mine[side], depth + 1, part / 2))
                self.axis.append(0), self.cut.append(0.0), self.down.append(-1)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.axis), np.array(self.cut), np.array(self.down)


def places(tree: tuple, p: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of all leaves that a row lives in or visits."""
    axis, at, down = tree
    row, node, home = np.arange(len(p)), np.zeros(len(p), np.int64), np.ones(len(p), bool)
    gap = np.zeros((len(p), p.shape[1]))
    done: list[tuple] = []
    while len(row):
        leaf = down[node] < 0
        done.append((row[leaf], node[leaf], home[leaf]))
        row, node, home, gap = row[~leaf], node[~leaf], home[~leaf], gap[~leaf]
        a = axis[node]
        v = p[row, a] - at[node]
        right = v >= 0
        # The other side: always for a visitor, only upwards from home.
        far = gap.copy()
        far[np.arange(len(row)), a] = np.maximum(far[np.arange(len(row)), a], np.abs(v))
        goes = (~home | ~right) & ((far * far).sum(axis=1) <= reach * reach + SLACK)
        row = np.concatenate([row, row[goes]])
        node = np.concatenate([down[node] + right, down[node[goes]] + ~right[goes]])
        home = np.concatenate([home, np.zeros(goes.sum(), bool)])
        gap = np.concatenate([gap, far[goes]])
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (row, node, home)


def part_links(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with cosine >= threshold. ``x`` and ``y`` are unit rows, tx and ty the same on principal axes."""
    d, i, j = x.shape[1], None, None
    for k in [s for s in STEPS if s < d]:
        px, py = leading(tx, k), leading(ty, k)
        if i is None:
            i, j = np.nonzero(px @ py.T >= threshold - SLACK)
        else:
            stay = np.einsum("ij,ij->i", px[i], py[j]) >= threshold - SLACK
            i, j = i[stay], j[stay]
        if not len(i):
            return i, j
    if i is None:
        i, j = np.nonzero(x @ y.T >= threshold - SLACK)
    stay = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[stay], j[stay]


def tile_links(x: np.ndarray, turned: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the left positions with the right ones (with each other, if both are one array), part by part."""
    near, k = 2 - 2 * threshold + SLACK, min(8, turned.shape[1])
    parts = []
    for side in (left, right):
        side = side[np.argsort(turned[side, 0], kind="stable")]
        cuts = [side[n : n + PART] for n in range(0, len(side), PART)]
        parts.append([(c, turned[c, :k].min(axis=0), turned[c, :k].max(axis=0)) for c in cuts])
    for m, (a, low_a, high_a) in enumerate(parts[0]):
        for q, (b, low_b, high_b) in enumerate(parts[1]):
            if left is right and q < m:
                continue
            apart = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
            if (apart * apart).sum() > near:
                continue
            i, j = part_links(x[a], x[b], turned[a], turned[b], threshold)
            if left is right and q == m:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield a[i], b[j]


def near_duplicates(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, block=block_rows,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``. ``block`` gives the rows of a block by vector length."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    v = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    good = (
        F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    good = F.coalesce(good, F.lit(False))
    # Two hashes of 64 bits, in which -0.0 and 0.0 are one value, name a class of equal vectors.
    key = [F.when(good, h).alias(k) for k, h in (("k1", F.xxhash64(F.lit(1), "label", "v")), ("k2", F.xxhash64(F.lit(2), "v", "label")))]
    rows = rows.select("*", *key)
    reps = rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")))
    turn = axes(reps)
    reach = float(np.sqrt(2 - 2 * threshold))

    # A tree for each vector length of which some label is too large for one task.
    most = {r["d"]: r["n"] for r in reps.groupBy("label", "d").count().groupBy("d").agg(F.max("count").alias("n")).collect()}
    trees: dict[int, tuple] = {}
    for d, n in most.items():
        points = None
        if n > block(d):
            total = reps.where(F.col("d") == d).count()
            some = reps.where((F.col("d") == d) & (F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / total) * (1 << 30))))

            def drawn(batches: Iterator[pa.RecordBatch], d: int = d) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for _, _, x in by_length(b.column(0)):
                        yield pa.RecordBatch.from_arrays([pa.array(list(leading(turn_by(x, turn[d]), min(AXES, d))), pa.list_(pa.float64()))], ["p"])

            got = some.select("v").mapInArrow(drawn, "p array<double>").toArrow()["p"]
            points = np.stack(got.to_numpy()) if len(got) else None
        trees[d] = Tree(points, block(d) / (2 * n)).arrays()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [(rows[r], leaf, home) for d, rows, x in by_length(b.column(0)) for r, leaf, home in [places(trees[d], leading(turn_by(x, turn[d]), min(AXES, d)), reach)]]
            r, leaf, home = (np.concatenate(c) for c in zip(*at, strict=True)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
            out = b.take(pa.array(r, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaf, pa.int64()), pa.array(home, pa.bool_())], [*b.schema.names, "leaf", "home"])

    by = ["label", "d", "leaf"]
    if any(len(t[2]) > 1 for t in trees.values()):
        placed = reps.select("v", "label", "d", "node", "copies").mapInArrow(place, f"v {kind}, label string, d int, node bigint, copies bigint, leaf bigint, home boolean")
    else:
        placed = reps.select("v", "label", "d", "node", "copies", F.lit(0).cast("long").alias("leaf"), F.lit(True).alias("home"))
    tiles = placed.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), (~F.col("home")).cast("int").alias("mine"))
    if any(n > block(d) for d, n in most.items()):
        # Groups beyond a block, at most rows / block of them.
        full = F.create_map(*[F.lit(x) for d in most for x in (d, float(block(d)))])
        blocks = lambda own: F.ceil(F.count_if(own) / F.first(full[F.col("d")])).cast("int")
        large = placed.groupBy(*by).agg(blocks(F.col("home")).alias("hb"), blocks(~F.col("home")).alias("vb")).where("hb > 1 or vb > 1")
        t = placed.join(cut(large), by, "left")
        h = F.xxhash64("node")
        mine = F.when(F.col("hb").isNull(), (~F.col("home")).cast("int")).when(F.col("home"), F.pmod(h, F.greatest("hb", F.lit(1)))).otherwise(F.col("hb") + F.pmod(h, F.greatest("vb", F.lit(1)))).cast("int")
        # A home block meets all blocks of the leaf, a visiting one the home blocks.
        last = F.when(F.col("home"), F.col("hb") + F.col("vb") - 1).otherwise(F.col("hb") - 1)
        t = t.withColumn("mine", mine).withColumn("other", F.explode(F.when(F.col("hb").isNull(), F.array(F.lit(-1))).when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
        own = F.col("other") < 0
        tiles = t.select("*", F.when(own, 0).otherwise(F.least("mine", "other")).alias("i"), F.when(own, 0).otherwise(F.greatest("mine", "other")).alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        x = next(by_length(t["v"].combine_chunks() if t["v"].num_chunks != 1 else t["v"].chunk(0)))[2]
        node, copies, mine = t["node"].to_numpy(), t["copies"].to_numpy(), t["mine"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        turned = turn_by(x, turn[x.shape[1]])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine != i)
        n, comp, a, b = np.zeros(len(x)), np.arange(len(x)), [], []
        for one, two in ([(left, left)] if i == j else []) + [(left, right)]:
            for p, q in tile_links(x, turned, one, two, threshold):
                n += np.bincount(p, copies[q], len(x)) + np.bincount(q, copies[p], len(x))
                used = spanning(comp, p, q)
                a.append(node[p[used]])
                b.append(node[q[used]])
        at = np.flatnonzero(n)
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        return pa.table({
            "a": pa.array(np.concatenate([node[at], a])), "b": pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(b, pa.int64())]),
            "n": pa.array(np.concatenate([n[at].astype(np.int64), np.zeros(len(a), np.int64)])),
        })

    tiles = tiles.select("v", "node", "copies", "mine", "i", "j", *by)
    found = cut(tiles.groupBy(*by, "i", "j").applyInArrow(compare, "a bigint, b bigint, n bigint"))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null"))

    named = reps.select("k1", "k2", "copies", "rep", "node").join(degree, "node", "left").join(comp, "node", "left")
    named = cut(named.select("k1", "k2", "copies", "rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", (F.col("n") + F.col("copies") - 1).alias("n"), "component_id")
    return rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
