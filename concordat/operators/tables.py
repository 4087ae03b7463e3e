"""Tables and text columns from row segments. What depends on the rows before runs page by page in pandas.

Segments: page, row, x0, x1, y0, y1, text. A page is a bounded group.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

LEAST_BANDS, LEAST_ROWS, ROW_GAP = 3, 2, 2.5
NUMERIC = r"^[^\w]*[\d.,\s%$€£-]+$"
CELLS = "page {p}, table long, row long, col long, text string"


def bands(spans: list[tuple[float, float]]) -> list[list[float]]:
    """Unions of overlapping spans, left to right."""
    out: list[list[float]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def column_of(x0: float, x1: float, columns: list[list[float]]) -> int:
    return max(range(len(columns)), key=lambda i: min(x1, columns[i][1]) - max(x0, columns[i][0]))


def runs(page: pd.DataFrame, fits) -> list[list[pd.DataFrame]]:
    """Successive rows that are near each other and go on with the run so far."""
    out: list[list[pd.DataFrame]] = []
    for _, row in page.sort_values(["y0", "x0"]).groupby("row", sort=False):
        height = (row.y1 - row.y0).median()
        near = out and out[-1] and row.y0.min() - out[-1][-1].y1.max() <= ROW_GAP * height
        if near and fits(out[-1], row):
            out[-1].append(row)
        elif fits([], row):
            out.append([row])
        else:
            out.append([])
    return [r for r in out if len(r) >= LEAST_ROWS]


def cells_of(page: object, tables: list[list[pd.DataFrame]]) -> pd.DataFrame:
    rows = []
    for t, run in enumerate(tables):
        columns = bands([(s.x0, s.x1) for row in run for s in row.itertuples()])
        for r, row in enumerate(run):
            text: dict[int, list[str]] = {}
            for s in row.sort_values("x0").itertuples():
                text.setdefault(column_of(s.x0, s.x1, columns), []).append(s.text)
            rows += [(page, t, r, c, " ".join(x)) for c, x in text.items()]
    return pd.DataFrame(rows, columns=["page", "table", "row", "col", "text"])


def aligned_tables(segments: DataFrame) -> DataFrame:
    """Cells of runs of two or more rows that share three or more columns."""

    def shared(run: list[pd.DataFrame], row: pd.DataFrame) -> bool:
        if len(row) < LEAST_BANDS:
            return False
        if not run:
            return True
        columns = bands([(s.x0, s.x1) for r in run for s in r.itertuples()])
        hit = {i for s in row.itertuples() for i, (a, b) in enumerate(columns) if min(s.x1, b) > max(s.x0, a)}
        return len(hit) >= LEAST_BANDS and len(bands([(s.x0, s.x1) for r in [*run, row] for s in r.itertuples()])) >= LEAST_BANDS

    find = lambda key, pdf: cells_of(key[0], runs(pdf, shared))
    return segments.groupBy("page").applyInPandas(lambda key, pdf: find(key, pdf), CELLS.format(p=segments.schema["page"].dataType.simpleString()))


def numeric_pairs(segments: DataFrame) -> DataFrame:
    """Cells of two-column tables: three or more full rows, two or more with a number on the right, and few labels that end in a colon."""

    def two(run: list[pd.DataFrame], row: pd.DataFrame) -> bool:
        if len(row) != 2:
            return False
        return not run or len(bands([(s.x0, s.x1) for r in [*run, row] for s in r.itertuples()])) == 2

    def good(run: list[pd.DataFrame]) -> bool:
        sides = [row.sort_values("x0").text.tolist() for row in run]
        numbers = sum(bool(re.match(NUMERIC, right)) and any(c.isdigit() for c in right) for _, right in sides)
        return len(run) >= 3 and numbers >= 2 and sum(left.rstrip().endswith(":") for left, _ in sides) < 0.6 * len(run)

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return cells_of(key[0], [r for r in runs(pdf, two) if good(r)])

    return segments.groupBy("page").applyInPandas(find, CELLS.format(p=segments.schema["page"].dataType.simpleString()))


def merge_wrapped(cells: DataFrame) -> DataFrame:
    """Rows with fewer cells than the table has columns join the full row above them."""
    by = ["page", "table"]
    wide = cells.groupBy(*by).agg(F.countDistinct("col").alias("width"))
    rows = cells.groupBy(*by, "row").agg(F.count(F.lit(1)).alias("n")).join(wide, by)
    w = Window.partitionBy(*by).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("logical", F.greatest(F.sum(F.when(F.col("n") == F.col("width"), 1).otherwise(0)).over(w) - 1, F.lit(0)).cast("long"))
    x = cells.join(rows.select(*by, "row", "logical"), [*by, "row"])
    g = x.groupBy(*by, "logical", "col").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("t"))
    return g.select(*by, F.col("logical").alias("row"), "col", F.array_join(F.transform("t", lambda s: s["text"]), " ").alias("text"))


def gutters(segments: DataFrame, least_rows: int = 4, least_chars: int = 12, least_share: float = 0.2) -> DataFrame:
    """(page, x0, x1) of the widest ink-free band of a page that runs through four or more rows of text on both sides."""

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf.x0.min(), pdf.x1.max()
        ink = bands([(s.x0, s.x1) for s in pdf.itertuples()])
        best = None
        for (_, a), (b, _) in zip(ink, ink[1:], strict=False):
            sides = [pdf[pdf.x1 <= a], pdf[pdf.x0 >= b]]
            both = set(sides[0].row) & set(sides[1].row)
            long_ = all(s.groupby("row").text.apply(lambda t: len(" ".join(t))).median() >= least_chars for s in sides if len(s))
            wide = min(a - left, right - b) >= least_share * (right - left)
            if len(both) >= least_rows and long_ and wide and (best is None or b - a > best[1] - best[0]):
                best = (a, b)
        return pd.DataFrame([(key[0], *best)] if best else [], columns=["page", "x0", "x1"])

    return segments.groupBy("page").applyInPandas(find, f"page {segments.schema['page'].dataType.simpleString()}, x0 double, x1 double")


def reading_order(segments: DataFrame) -> DataFrame:
    """Segments with a position: left text column before right where a gutter parts the page, top to bottom inside."""
    g = gutters(segments).select("page", F.col("x0").alias("g0"))
    x = segments.join(g, "page", "left").withColumn("column", F.when(F.col("g0").isNull(), 0).otherwise((F.col("x0") > F.col("g0")).cast("int")))
    w = Window.partitionBy("page").orderBy("column", "y0", "x0")
    return x.withColumn("position", F.row_number().over(w)).drop("g0")
