"""Line dedup by a log-template tree.

A line is trimmed, white space runs become one space, and tokens with a digit become the
wildcard. The tree has a fixed depth: token count, then the ``LEAD`` leading tokens; that
path is the leaf. Inside a leaf, lines join the template they agree with in at least
``agreement`` of their tokens, position by position, and differing positions become
wildcards. A template recurs in every document that has one of its lines. Templates that
recur in ``least_documents`` different documents, or, from ``long_tokens`` tokens on, in
``least_long``, are dropped wherever they stand, except in the document with the smallest
id, so the text that everybody copied remains once.

What moves between tasks is hashes of lines. Line texts are gathered only for leaves in
which several different lines could form a recurring template. A leaf of more than ``BLOCK``
different lines is split into the components of lines that share a key: words at positions
of which lines that agree must have some set in common. A line that can join a template
shares a key with the line that founded it, so parsing each component alone gives what
parsing the whole leaf gives. The filters that pick those lines are broadcast only if they
count at most ``SMALL`` rows; beyond that the same joins shuffle.

Lines of fewer than ``least_tokens`` tokens stay: a single word recurs by chance. Lines of
any length are parsed whole. Nulls: a null text has no lines and stays null; rows with a
null id never are the one that keeps a template, unless all are. Ties: of templates that a
line agrees with equally the oldest takes it, lines being parsed by falling frequency and
then by text; all rows of the smallest id keep a template. Rows that repeat count as
documents of their own and are changed alike. An empty table gives an empty result. Other
columns pass through, but for n_lines, n_dropped and dropped_at, which the result's replace.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from concordat.llm.components import components
from concordat.llm.shared import apart, cut

LEAD = 3
WILD = "<*>"
BLOCK = 2000
KEYS = 32
SMALL = 50_000


def masked(line: Column) -> Column:
    """The line in the tree's normal form; empty if it has no word. Most lines pass one test and no replacement."""
    x = F.btrim(line, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    spaced = F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")
    return F.when(x.rlike(r"[0-9\x09-\x0D]|\x20\x20"), F.regexp_replace(spaced, r"[^\x20]*[0-9][^\x20]*", WILD)).otherwise(x)


def leaf(line: Column, least_tokens: int, long_tokens: int) -> Column:
    """Hash of token count and leading tokens, odd for long lines; 0 for a line of fewer than ``least_tokens`` tokens."""
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    enough = F.substring_index(line, " ", least_tokens - 1) != line if least_tokens > 1 else line != ""
    h = F.xxhash64(tokens, F.substring_index(line, " ", LEAD)).bitwiseAND(-2) + (tokens >= long_tokens).cast("long")
    return F.when(enough, h).otherwise(F.lit(0).cast("long"))


@cache
def key_positions(n: int, agreement: float) -> list[tuple[int, ...]]:
    """Sets of positions, at least one of which is equal throughout in any two lines of n tokens that agree.

    At most k positions differ, so of k + r segments r stay equal: one set for each choice of r segments, with the
    largest r that makes at most KEYS sets (or r = 1). A leaf's lines share the leading tokens, which are left out.
    """
    at = range(LEAD, n)
    k = n - math.ceil(agreement * n)
    if k >= len(at):
        return [()]
    r = 1
    while k + r < len(at) and math.comb(k + r + 1, r + 1) <= KEYS:
        r += 1
    parts = [at[i * len(at) // (k + r) : (i + 1) * len(at) // (k + r)] for i in range(k + r)]
    return [tuple(p for part in some for p in part) for some in combinations(parts, r)]


def grow(lines: list[list[str]], agreement: float) -> tuple[list[int], list[list[str]]]:
    """Group number of each line of a leaf (one token count), in the given order, and the groups' templates.

    A line joins the group it agrees with best; on a tie, the oldest. Positions in which a group's lines
    differ agree with nothing, so a template does not swallow what it never saw.
    """
    templates: list[list[str | None]] = []
    found: dict[tuple, list[int]] = {}
    out = []
    for line in lines:
        keys = [(i, *[line[p] for p in at]) for i, at in enumerate(key_positions(len(line), agreement))]
        best, most = -1, -1
        for g in sorted({g for key in keys for g in found.get(key, ())}):
            same = sum(a == b for a, b in zip(templates[g], line, strict=True))
            if same > most:
                best, most = g, same
        if best >= 0 and most >= agreement * len(line):
            templates[best] = [a if a == b else None for a, b in zip(templates[best], line, strict=True)]
        else:
            best = len(templates)
            templates.append(line)
            for key in keys:
                found.setdefault(key, []).append(best)
        out.append(best)
    return out, [[WILD if a is None else a for a in t] for t in templates]


def linked(lines: DataFrame, agreement: float) -> DataFrame:
    """(h, component) of the lines (leaf, h, line) that share a key with another line of their leaf."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, key = [], []
            for leaf_, own, line in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                tokens = line.split(" ")
                for i, at in enumerate(key_positions(len(tokens), agreement)):
                    words = " ".join([str(leaf_), str(i), *[tokens[p] for p in at]])
                    h.append(own)
                    key.append(int.from_bytes(hashlib.blake2b(words.encode(), digest_size=8).digest(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(key, pa.int64())], ["h", "key"])

    key = cut(lines.select("leaf", "h", "line").mapInArrow(keyed, "h bigint, key bigint"))
    least = cut(key.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key", "low"))
    return components(key.join(least, "key").select("h", "low"), "h", "low").withColumnRenamed("node", "h")


def dropped_lines(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least_documents: int = 3, least_tokens: int = 3, agreement: float = 0.8,
    long_tokens: int = 50, least_long: int = 2,
) -> DataFrame:
    """Row hashes r1, r2, position and leaf of every line to be dropped."""
    row = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    row = row.select("doc", "text", F.xxhash64(F.lit(1), "doc", "text").alias("r1"), F.xxhash64("text", "doc").alias("r2"))
    # Lines are exploded before they are masked, so masking is generated code and runs once for each line;
    # short lines are left out after the cut, as a filter before it would mask each line again.
    lines = row.select("doc", "r1", "r2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).withColumn("line", masked(F.col("raw")))
    slim = cut(lines.select("doc", "r1", "r2", "pos", leaf(F.col("line"), least_tokens, long_tokens).alias("leaf"), F.xxhash64("line").alias("h"))).where("leaf <> 0")

    need = F.when(F.col("leaf").bitwiseAND(1) == 1, least_long).otherwise(least_documents)

    by_row = slim.groupBy("leaf", "h", "r1", "r2", "doc", "pos").agg(F.count(F.lit(1)).alias("rows")).groupBy("leaf", "h", "r1", "r2", "doc").agg(F.max("rows").alias("rows"))
    each = cut(by_row.groupBy("leaf", "h").agg(F.sum("rows").alias("docs"), F.min("doc").alias("first"), F.max("doc").alias("last")))
    leaves = each.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("lines")).where(F.col("docs") >= need)
    leaves = cut(leaves.select("leaf", "lines"))

    # Leaves of a single line need no text: the line is the template.
    alone = each.join(leaves.where("lines = 1"), "leaf").select("leaf", "h", "docs", "first", "last", F.lit("").alias("template"), F.col("h").alias("group"))
    mixed = checked(leaves.where("lines > 1").select("leaf", (F.col("lines") > BLOCK).alias("large")))
    # Here lines are masked inside the array: the join needs the line beside its leaf, and would mask it for each.
    text_of = row.select(F.explode(F.transform(F.split("text", "\n", -1), masked)).alias("line"))
    text_of = text_of.select("line", leaf(F.col("line"), least_tokens, long_tokens).alias("leaf")).join(mixed, "leaf")
    text_of = text_of.groupBy("leaf", "line", "large").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("line"))
    known = text_of.join(each, ["leaf", "h"]).select("leaf", F.lit(0).cast("long").alias("block"), "h", "line", "docs", F.col("first"), F.col("last"), "large")
    if not mixed.where("large").isEmpty():
        large = cut(known.where("large"))
        parts = large.drop("block").join(cut(linked(large, agreement)), "h", "left")
        # A line that shares no key with another is its own template.
        single = parts.where("component is null").select("leaf", "h", "docs", "first", "last", F.lit("").alias("template"), F.col("h").alias("group"))
        alone = alone.unionByName(single)
        parts = parts.where("component is not null").withColumnRenamed("component", "block")
        known = known.where("not large").unionByName(parts)
    known = known.drop("large")

    def parse(t: pa.Table) -> pa.Table:
        t = t.sort_by([("docs", "descending"), ("line", "ascending")])
        group, templates = grow([s.split(" ") for s in t["line"].to_pylist()], agreement)
        made = [" ".join(x) for x in templates]
        t = t.select(["leaf", "h", "docs", "first", "last"])
        return t.append_column("template", pa.array([made[g] for g in group], pa.string()))

    kind = slim.schema["doc"].dataType.simpleString()
    formed = known.groupBy("leaf", "block").applyInArrow(parse, f"leaf bigint, h bigint, docs bigint, first {kind}, last {kind}, template string")
    formed = formed.withColumn("group", F.xxhash64("template"))
    member = cut(alone.unionByName(formed).select("leaf", "h", "docs", "first", "last", "group"))
    total = member.groupBy("leaf", "group").agg(F.count(F.lit(1)).alias("lines"), F.sum("docs").alias("docs"), F.min("first").alias("keeper"), F.max("last").alias("last"))
    total = cut(total.where(F.col("docs") >= need).where(~F.col("keeper").eqNullSafe(F.col("last"))).drop("last"))
    # A template of several lines may stand twice in one document, which counts once.
    several = checked(member.join(total.where("lines > 1").select("leaf", "group"), ["leaf", "group"]).select("leaf", "h", "group"))
    rows = slim.join(several, ["leaf", "h"]).groupBy("leaf", "group", "r1", "r2", "h", "pos").agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.groupBy("leaf", "group", "r1", "r2").agg(F.max("rows").alias("rows")).groupBy("leaf", "group").agg(F.sum("rows").alias("rows"))
    rows = rows.where(F.col("rows") >= need).select("leaf", "group")
    total = total.where("lines = 1").select("leaf", "group", "keeper").unionByName(total.join(rows, ["leaf", "group"]).select("leaf", "group", "keeper"))
    drop = checked(member.join(total, ["leaf", "group"]).select("leaf", "h", "keeper"))
    return slim.join(drop, ["leaf", "h"]).where(~F.col("doc").eqNullSafe(F.col("keeper"))).select("r1", "r2", "pos", "leaf")


def checked(df: DataFrame) -> DataFrame:
    """Computed once; broadcast if it counts at most SMALL rows of a few numbers each."""
    df = cut(df)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", most_dropped: float = 1.0, **rules: float) -> DataFrame:
    """``docs`` with the recurring lines gone from ``text``, and n_lines, n_dropped and dropped_at (line numbers from 0).

    A document that would lose more than ``most_dropped`` of its characters is left whole (1: none is).
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "dropped_at")]
    docs, names = apart(docs)
    text, doc_id = names[text], names[doc_id]
    gone = dropped_lines(docs, text=text, doc_id=doc_id, **rules)
    gone = gone.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("dropped_at"))
    t = F.col(text).cast("string")
    keep = docs.select(*[names[c] for c in columns])
    keyed = keep.withColumn("__r1", F.xxhash64(F.lit(1), F.col(doc_id), t)).withColumn("__r2", F.xxhash64(t, F.col(doc_id)))
    gone = gone.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), "dropped_at")
    out = keyed.join(gone, ["__r1", "__r2"], "left").drop("__r1", "__r2")
    if most_dropped < 1:
        lost = F.aggregate(F.filter(F.split(t, "\n", -1), lambda x, i: F.array_contains("dropped_at", i)), F.lit(0), lambda n, x: n + F.length(x))
        out = out.withColumn("dropped_at", F.when(lost <= most_dropped * F.length(t), F.col("dropped_at")))
    left = F.array_join(F.filter(F.split(t, "\n", -1), lambda x, i: ~F.array_contains("dropped_at", i)), "\n")
    return out.select(
        *[(F.when(F.col("dropped_at").isNull(), t).otherwise(left) if names[c] == text else F.col(names[c])).alias(c) for c in columns],
        F.when(t.isNull(), F.lit(0)).otherwise(F.size(F.split(t, "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped_at"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped_at", F.array().cast("array<int>")).alias("dropped_at"),
    )
