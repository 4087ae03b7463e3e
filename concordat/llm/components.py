"""Connected components of a link table by repeated contraction.

In each round every node joins its smallest neighbour (or itself) under a random order
that is drawn anew for the round, and links between what results form the next, smaller
graph. A fixed share of the nodes goes in every round, whatever the graph's shape, so
the rounds grow with the logarithm of its size. All tables stay distributed and are cut
off into the shared folder; joins run between such tables, so a node with very many
links is split by adaptive execution, and minima and distinct links are taken after a
partial aggregation in the map tasks. A graph of at most ``FEW`` links, given or left by
the rounds, is solved by one task: a bounded group, and the same answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concordat.llm.shared import cut

FEW = 16_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of ``links`` (long ids) the smallest id it reaches."""
    e = cut(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    maps: list[DataFrame] = []
    while e.limit(FEW + 1).count() > FEW:
        both = e.union(e.select("b", "a"))
        # min_by of fixed-width values stays in hash aggregation, partial in the map tasks.
        seed = F.lit(len(maps))
        near = both.groupBy("a").agg(F.min_by("b", F.xxhash64(seed, "b")).alias("b"))
        own = F.xxhash64(seed, "a") <= F.xxhash64(seed, "b")
        m = cut(near.select(F.col("a").alias("node"), F.when(own, F.col("a")).otherwise(F.col("b")).alias("to")))
        maps.append(m)
        left = e.join(m, e["a"] == m["node"]).select(F.col("to").alias("a"), "b")
        e = cut(left.join(m, left["b"] == m["node"]).select(F.least("a", "to").alias("a"), F.greatest("a", "to").alias("b")).where("a <> b").distinct())
    last = e.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(solve, "node bigint, component bigint")
    if not maps:
        return last
    last = cut(last)
    out = maps[0]
    for m in [*maps[1:], last.withColumnRenamed("component", "to")]:
        up = m.select(F.col("node").alias("via"), F.col("to").alias("end"))
        out = out.join(up, out["to"] == up["via"], "left").select("node", F.coalesce("end", "to").alias("to"))
    out = cut(out)
    least = out.groupBy("to").agg(F.min("node").alias("component"))
    return out.join(least, "to").select("node", "component")


def solve(t: pa.Table) -> pa.Table:
    """Components of the links (a, b) of one task."""
    ids, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
    comp = np.arange(len(ids))
    spanning(comp, at[: t.num_rows], at[t.num_rows :])
    return pa.table({"node": ids, "component": ids[comp]})


def spanning(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions of links (i, j) that connect what all of them connect, fewer than there are nodes.

    ``comp`` has the smallest position of each position's component and is brought up to date.
    """
    at, used = np.arange(len(i)), []
    while True:
        a, b = comp[i[at]], comp[j[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            return np.concatenate(used) if used else np.zeros(0, np.int64)
        # Each component hangs on one that is smaller, so no circle can close.
        high, first = np.unique(np.maximum(a, b), return_index=True)
        used.append(at[first])
        up = np.arange(len(comp))
        up[high] = np.minimum(a, b)[first]
        while (up[up] != up).any():
            up = up[up]
        comp[:] = up[comp]
