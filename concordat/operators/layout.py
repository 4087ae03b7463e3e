"""Geometry of word boxes: rows, segments, bands, blocks, serialization, page confidence.

Steps that compare a box with its neighbour in an order are gaps-and-islands windows over
one page; grouping words into rows depends on the rows before and runs page by page in
pandas. A page is a bounded group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

SEGMENT_GAP = 1.5
OVERLAP = 0.4
LOOK_BACK = 3


def islands(rows: DataFrame, by: list[str], order: list[str], new: Column, name: str) -> DataFrame:
    """Number runs within ``by``: a row for which ``new`` holds begins the next run."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def segments(words: DataFrame, by: list[str], height: Column, start: str = "x0", end: str = "x1", order: tuple[str, ...] = ()) -> DataFrame:
    """Words of a row split where the gap is over 1.5 times the given height."""
    w = Window.partitionBy(*by).orderBy(start, *order)
    x = words.withColumn("__gap", F.col(start) - F.lag(end).over(w)).withColumn("__h", height)
    return islands(x, by, [start, *order], F.col("__gap") > SEGMENT_GAP * F.col("__h"), "segment").drop("__gap", "__h")


def clusters(points: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """One-dimensional clusters: a point joins its left neighbour within the tolerance."""
    w = Window.partitionBy(*by).orderBy(value)
    x = points.withColumn("__gap", F.col(value) - F.lag(value).over(w))
    return islands(x, by, [value], F.col("__gap") > tolerance, "cluster").drop("__gap")


def merge_bands(intervals: DataFrame, by: list[str], lo: str, hi: str, order: tuple[str, ...] = ()) -> DataFrame:
    """(by, lo, hi, n) of the unions of overlapping intervals."""
    w = Window.partitionBy(*by).orderBy(lo, *order)
    x = intervals.withColumn("__reach", F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = islands(x, by, [lo, *order], F.col(lo) > F.col("__reach"), "band")
    return x.groupBy(*by, "band").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("band")


def grid_cells(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Row and column numbers of boxes from the ranks of their top and left edges."""
    rank = lambda c: (F.dense_rank().over(Window.partitionBy(*by).orderBy(c)) - 1).alias(c)
    return boxes.withColumn("row", rank("y0")).withColumn("col", rank("x0"))


def rows_of_words(words: DataFrame) -> DataFrame:
    """(page, word, row): words top to bottom join one of the last three rows that they overlap by 40 % of the smaller height and do not cover."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        out = []
        for w in pdf.sort_values(["y0", "x0", "word"]).itertuples():
            best = None
            for r in reversed(rows[-LOOK_BACK:]):
                shared = min(w.y1, r["y1"]) - max(w.y0, r["y0"])
                if shared >= OVERLAP * min(w.y1 - w.y0, r["y1"] - r["y0"]) and all(w.x1 <= a or w.x0 >= b for a, b in r["spans"]):
                    best = r
                    break
            if best is None:
                best = {"id": len(rows), "y0": w.y0, "y1": w.y1, "spans": []}
                rows.append(best)
            best["spans"].append((w.x0, w.x1))
            best["y0"], best["y1"] = min(best["y0"], w.y0), max(best["y1"], w.y1)
            out.append((w.page, w.word, best["id"]))
        return pd.DataFrame(out, columns=["page", "word", "row"])

    k, n = (words.schema[c].dataType.simpleString() for c in ("page", "word"))
    return words.groupBy("page").applyInPandas(group, f"page {k}, word {n}, row long")


def blocks(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines of a region joined while the gap to the line above is at most a line's height."""
    w = Window.partitionBy(*by).orderBy("y0")
    x = lines.withColumn("__gap", F.col("y0") - F.lag("y1").over(w))
    return islands(x, by, ["y0"], F.col("__gap") > F.col("y1") - F.col("y0"), "block").drop("__gap")


def serialize(lines: DataFrame, by: list[str], position: str, column: str, text: str) -> DataFrame:
    """Text of a page in reading order, with a mark where the column changes."""
    w = Window.partitionBy(*by).orderBy(position)
    x = lines.withColumn("__new", ~F.col(column).eqNullSafe(F.lag(column).over(w)) & F.col(column).isNotNull())
    shown = F.when(F.col("__new"), F.concat(F.lit("[COLUMN "), F.col(column).cast("string"), F.lit("]\n"), F.col(text))).otherwise(F.col(text))
    g = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), shown.alias("t")))).alias("l"))
    return g.select(*by, F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("text"))


def page_confidence(words: DataFrame, floor: float = 0.6) -> DataFrame:
    """Share of characters in lines whose mean confidence reaches the floor (page, line, text, confidence)."""
    lines = words.groupBy("page", "line").agg(F.avg("confidence").alias("mean"), F.sum(F.length("text")).alias("chars"))
    return lines.groupBy("page").agg((F.sum(F.when(F.col("mean") >= floor, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("confidence"))


def first_acceptable(readings: DataFrame, floor: float = 0.6) -> DataFrame:
    """The reading of each page that the chain of backends ends with (page, ordinal, text, confidence, geometry).

    The first with text at or over the floor; else the best rejected one, as degraded. The
    witness is the latest rejected reading with geometry before the accepted one.
    """
    some = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    r = readings.withColumn("ok", some & (F.col("confidence") >= floor)).withColumn("some", some)
    g = r.groupBy("page").agg(
        F.min(F.when(F.col("ok"), F.col("ordinal"))).alias("accepted"),
        F.max_by("ordinal", F.when(F.col("some"), F.struct(F.col("confidence"), -F.col("ordinal")))).alias("best"), F.max(F.col("some").cast("int")).alias("any"),
    )
    x = g.select("page", F.coalesce("accepted", F.when(F.col("any") == 1, F.col("best"))).alias("ordinal"), F.col("accepted").isNull().alias("degraded"))
    before = r.join(g.select("page", "accepted"), "page").where("some and not ok and geometry").where(F.col("accepted").isNull() | (F.col("ordinal") < F.col("accepted")))
    witness = before.groupBy("page").agg(F.max("ordinal").alias("witness"))
    return x.join(witness, "page", "left").withColumn("witness", F.when(~F.col("degraded"), F.col("witness")))


def escalation_winner(attempts: DataFrame) -> DataFrame:
    """The attempt with fewest errors; on a tie the later one (doc_id, attempt, errors)."""
    return attempts.groupBy("doc_id").agg(F.min_by("attempt", F.struct("errors", (-F.col("attempt")).alias("late"))).alias("attempt"), F.min("errors").alias("errors"))


def highlights(sources: DataFrame) -> DataFrame:
    """(doc_id, field, page, region) of a map of field to struct<page, regions>."""
    x = sources.select("doc_id", F.explode("field_sources").alias("field", "s"))
    return x.select("doc_id", "field", F.col("s.page").alias("page"), F.explode("s.regions").alias("region"))


def witness_amounts(words: DataFrame, floor: float = 0.6, touch: float = 0.2) -> DataFrame:
    """(page, line, amounts): touching boxes of a line glued, doubtful glued words left out, amounts in order without repeats.

    words: page, line, x0, x1, y0, y1, text, confidence.
    """
    from concordat.functions import money

    w = Window.partitionBy("page", "line").orderBy("x0", "x1")
    x = words.withColumn("__gap", F.col("x0") - F.lag("x1").over(w))
    x = islands(x, ["page", "line"], ["x0", "x1"], F.col("__gap") > touch * (F.col("y1") - F.col("y0")), "run")
    glued = x.groupBy("page", "line", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), "").alias("text"), F.min("confidence").alias("confidence")
    ).where(F.col("confidence") >= floor)
    g = glued.groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("run", "text"))).alias("r"))
    text = F.array_join(F.transform("r", lambda s: s["text"]), " ")
    return g.select("page", "line", F.array_distinct(money.amounts_in(text)).alias("amounts")).where(F.size("amounts") > 0)


def source_status(located: DataFrame, citations: DataFrame) -> DataFrame:
    """(doc_id, field, status): verified on the page, fuzzy, conflicting where only the witness has it, else unlocated.

    located: doc_id, field, reading ('page' or 'witness'), score.
    """
    g = located.groupBy("doc_id", "field").agg(
        F.max(F.when(F.col("reading") == "page", F.col("score"))).alias("page"), F.max(F.when(F.col("reading") == "witness", F.col("score"))).alias("witness")
    )
    status = F.when(F.col("page") == 1.0, "verified").when(F.col("page").isNotNull(), "fuzzy").when(F.col("witness").isNotNull(), "conflicting").otherwise("unlocated")
    return citations.select("doc_id", "field").join(g, ["doc_id", "field"], "left").select("doc_id", "field", status.alias("status"))


def engine_words(rows: DataFrame) -> DataFrame:
    """Words of an engine's rows: blanks and negative confidences left out, confidence from percent to a share."""
    return rows.where((F.trim("text") != "") & (F.col("confidence") >= 0)).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") / 100))


def flipped(y0: Column, y1: Column, height: Column) -> tuple[Column, Column]:
    """Vertical edges of a box from a bottom-left to a top-left origin."""
    return height - y1, height - y0


def rotated(x0: Column, y0: Column, x1: Column, y1: Column, degrees: Column) -> Column:
    """struct<x0, y0, x1, y1> of a box of the unit square turned clockwise by 0, 90, 180 or 270 degrees."""
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    return (
        F.when(degrees == 90, box(1 - y1, x0, 1 - y0, x1)).when(degrees == 180, box(1 - x1, 1 - y1, 1 - x0, 1 - y0))
        .when(degrees == 270, box(y0, 1 - x1, y1, 1 - x0)).otherwise(box(x0, y0, x1, y1))
    )


def rotation_vote(glyphs: DataFrame) -> DataFrame:
    """The most frequent direction of a page's glyphs; the smallest on a tie."""
    n = glyphs.groupBy("page", "direction").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("page").agg(F.max_by("direction", F.struct("n", (-F.col("direction")).alias("d"))).alias("direction"))


def split_cell(cells: DataFrame) -> DataFrame:
    """Words of a cell's text, each with a share of the box by its number of characters (cell, x0, x1, text)."""
    x = cells.select("cell", "x0", "x1", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "word"))
    upto = Window.partitionBy("cell").orderBy("pos")
    size = F.length("word")
    x = x.withColumn("before", F.coalesce(F.sum(size).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum(size).over(Window.partitionBy("cell")))
    at = lambda c: F.col("x0") + (F.col("x1") - F.col("x0")) * c / F.col("all")
    return x.select("cell", "pos", "word", at(F.col("before")).alias("w0"), at(F.col("before") + size).alias("w1"))
