"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents that belong to the same set of sources are interchangeable, so the flow runs
over patterns, not documents: a pattern's words flow to any of its sources, the k-th
repetition of a word costs k, and a source takes no more than its quota. Convex costs
make the flow use every document once before it uses any twice. The network has one node
per pattern and per source, so its size depends on the number of sources, not of rows.

Selection then turns each (pattern, source) flow into documents: ``flow // size`` whole
passes, and for the rest the documents that come first in a seeded order. The running sum
behind that order is taken over a histogram of the order's hash first, then only inside
the one bucket where the sum crosses the quota, so no task holds a source. Up to
``FILLS`` documents of the sizes nearest to what is then missing close the gap.

Nulls: a null text has size 0, a null source is a source of its own that sorts last, a
null id takes part like any other. Empty tables give an empty result. Rows that repeat
are documents of their own; ties in the seeded order are broken by the id and then count
together. Columns of the input with the names of result columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from concordat.llm.shared import WORD, apart, cut

BUCKETS = 4096
FILLS = 3
MAX_PATTERNS = 200_000


def size_of(text: Column) -> Column:
    """Words of a text; null has none. Java's regexp_count is a long scan of native code."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quotas(sizes: list[tuple[str | None, int]], weights: list[float], most: float = 3.0) -> list[float]:
    """Share all words by weight; who reaches ``most`` times its size stops there and the rest is shared again."""
    total, target, open_ = float(sum(s for _, s in sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i][1]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i][1]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], target: list[float], repeats: int = 3) -> dict[tuple[int, int], float]:
    """Words from pattern p to source s. Repetition k of a word costs k; quotas bound the sources.

    Successive shortest paths: all arcs out of a pattern cost the same, so a cheapest path
    is one through the fewest repetitions, and a breadth-first search over residual arcs
    within one repetition level finds it. Levels go upwards, which keeps the flow optimal.
    """
    flow: dict[tuple[int, int], float] = {}
    used, need = [0.0] * len(patterns), [float(t) for t in target]
    members: list[list[int]] = [[] for _ in target]
    for p, (srcs, _) in enumerate(patterns):
        for s in srcs:
            members[s].append(p)
    eps = 1e-9 * (1 + sum(need))
    for level in range(1, repeats + 1):
        spare = [max(0.0, level * size - u) for (_, size), u in zip(patterns, used, strict=True)]
        while True:
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p, x in enumerate(spare) if x > eps}
            queue, end = list(came), None
            for node in queue:
                kind, i = node
                if kind == "s" and need[i] > eps:
                    end = node
                    break
                nxt = [("s", s) for s in patterns[i][0]] if kind == "p" else [("p", p) for p in members[i] if flow.get((p, i), 0) > eps]
                for x in nxt:
                    if x not in came:
                        came[x] = node
                        queue.append(x)
            if end is None:
                break
            path = [end]
            while (before := came[path[-1]]) is not None:
                path.append(before)
            path.reverse()
            room = min(spare[path[0][1]], need[end[1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "s":
                    room = min(room, flow[b[1], a[1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    flow[a[1], b[1]] = flow.get((a[1], b[1]), 0.0) + room
                else:
                    flow[b[1], a[1]] -= room
            spare[path[0][1]] -= room
            used[path[0][1]] += room
            need[end[1]] -= room
    return {k: v for k, v in flow.items() if v > eps}


def mix(
    docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (whole passes plus the seeded remainder).

    ``source`` may be a string or an array of strings, for documents of several sources.
    Weights go to the sources in code point order, repeating, null last. source_size and
    target of a document of several sources are those of its first source in that order.
    ``taken`` is a multiple of the size, at most ``most`` (rounded down) of it.

    The membership patterns are gathered by the driver, at most ``MAX_PATTERNS`` of them;
    beyond that the call fails rather than leave any out.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    docs, names_of = apart(docs)
    text, source, doc_id = (names_of[c] for c in (text, source, doc_id))
    many = isinstance(docs.schema[source].dataType, T.ArrayType)
    pattern = F.array_sort(F.array_distinct(F.col(source))) if many else F.array(F.col(source))
    own = docs.withColumn("__size", size_of(F.col(text))).withColumn("__pattern", pattern)
    # The order depends on the row only: reruns and lost executors give the same mix.
    own = own.withColumn("__rank", F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col("__size")))
    own = own.withColumn("__bucket", F.pmod(F.col("__rank"), F.lit(BUCKETS)).cast("int"))
    slim = cut(own.select("__pattern", "__size", "__rank", "__bucket"))

    hist = cut(slim.groupBy("__pattern", "__bucket").agg(F.sum("__size").alias("words")))
    pats = hist.groupBy("__pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(pats) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources; coarsen the source column")
    names = sorted({s for r in pats for s in (r["__pattern"] or [None])}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    patterns = [(tuple(sorted(index[s] for s in (r["__pattern"] or [None]))), int(r["words"])) for r in pats]
    size = [0] * len(names)
    for srcs, n in patterns:
        for s in srcs:
            size[s] += n
    # A word of several sources counts in each; the total shared is that of the documents.
    whole = sum(n for _, n in patterns)
    scale = whole / sum(size) if sum(size) else 0.0
    share = quotas([(s, size[i] * scale) for i, s in enumerate(names)], [weights[i % len(weights)] for i in range(len(names))], most)
    flow = min_cost_flow(patterns, share, int(most))

    plan = []
    for p, (srcs, n) in enumerate(patterns):
        out = sum(flow.get((p, s), 0.0) for s in srcs)
        passes = min(int(out // n), int(most)) if n else 0
        plan.append((pats[p]["__pattern"], size[srcs[0]], float(share[srcs[0]]), passes, max(0.0, out - passes * n) if passes < int(most) else 0.0))
    schema = T.StructType([
        T.StructField("__pattern", T.ArrayType(T.StringType())), T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()), T.StructField("passes", T.LongType()), T.StructField("rest", T.DoubleType()),
    ])
    plan = spark.createDataFrame(plan, schema)
    same = lambda a, b: a["__pattern"].eqNullSafe(b["__pattern"])

    # The bucket in which a pattern's remainder is used up, and the words before it.
    upto = Window.partitionBy("__pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    run = hist.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0).cast("long")))
    h = run.alias("h").join(F.broadcast(plan.select("__pattern", "rest").alias("q")), F.col("h.__pattern").eqNullSafe(F.col("q.__pattern")))
    edge = (
        h.where("before < rest and before + words >= rest")
        .select(F.col("h.__pattern").alias("__pattern"), F.col("__bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("left"))
    )
    edge = cut(edge)
    inside = slim.alias("d").join(F.broadcast(edge.alias("e")), F.col("d.__pattern").eqNullSafe(F.col("e.__pattern")) & (F.col("d.__bucket") == F.col("e.edge")))
    order = Window.partitionBy("p").orderBy("__rank")
    # Rows with the same rank come in or stay out together.
    inside = inside.groupBy(F.col("d.__pattern").alias("p"), F.col("d.__rank").alias("__rank"), "left").agg(F.sum("d.__size").alias("words"))
    inside = inside.withColumn("sum", F.sum("words").over(order)).where("sum <= left")
    last = inside.groupBy(F.col("p").alias("__pattern")).agg(F.max("__rank").alias("last"), F.max("sum").alias("sum"))
    last = edge.alias("e").join(last.alias("l"), F.col("e.__pattern").eqNullSafe(F.col("l.__pattern")), "left").select(
        "e.*", "last", (F.col("left") - F.coalesce(F.col("sum"), F.lit(0))).alias("gap")
    )
    last = cut(last)
    # What is still missing comes from single documents of those left: twice the largest that fits, then the nearest.
    after = (F.col("__bucket") > F.col("edge")) | ((F.col("__bucket") == F.col("edge")) & (F.col("last").isNull() | (F.col("__rank") > F.col("last"))))
    last = cut(last.withColumn("fill", F.array().cast("array<bigint>")))
    for turn in range(FILLS):
        fits = "words <= gap" if turn < FILLS - 1 else "words < 2 * gap"
        best = (
            slim.where("__size > 0").alias("d")
            .join(F.broadcast(last.alias("e")), F.col("d.__pattern").eqNullSafe(F.col("e.__pattern")) & after & ~F.array_contains("fill", F.col("__rank")))
            .groupBy(F.col("d.__pattern").alias("p"), "__rank", "gap").agg(F.sum("__size").alias("words")).where(fits)
            .groupBy("p").agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), "__rank", "words")).alias("b"))
        )
        last = cut(last.alias("e").join(best.alias("n"), F.col("e.__pattern").eqNullSafe(F.col("n.p")), "left").select(
            "__pattern", "edge", "left", "last", (F.col("gap") - F.coalesce(F.col("b.words"), F.lit(0))).alias("gap"),
            F.when(F.col("b").isNull(), F.col("fill")).otherwise(F.concat("fill", F.array("b.__rank"))).alias("fill"),
        ))
    plan = plan.alias("q").join(last.alias("e"), F.col("q.__pattern").eqNullSafe(F.col("e.__pattern")), "left").select("q.*", "edge", "last", "fill")
    plan = cut(plan).withColumnRenamed("__pattern", "__of")
    extra = F.when(
        (F.col("rest") > 0)
        & (F.col("edge").isNull() | (F.col("__bucket") < F.col("edge")) | ((F.col("__bucket") == F.col("edge")) & (F.col("__rank") <= F.col("last"))) | (F.array_contains("fill", F.col("__rank")))),
        1,
    ).otherwise(0)
    return own.join(F.broadcast(plan), F.col("__pattern").eqNullSafe(F.col("__of")), "left").select(
        *[F.col(names_of[c]).alias(c) for c in kept], F.col("__size").alias("size"), "source_size", "target",
        (F.col("__size") * (F.col("passes") + extra)).cast("long").alias("taken"),
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows: each document as often as it is taken; a document of no words is left out."""
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.select(*columns, F.explode(F.sequence(F.lit(0), times)).alias("__copy")).where("__copy > 0").select(*columns)
