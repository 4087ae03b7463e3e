"""CSV and JSON lines; nothing is brought into one file unless the caller asks for an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concordat.operators.export import guarded


def write_csv(df: DataFrame, path: str, guard: bool = True) -> None:
    """All columns as text, header in every part; text cells are kept from being formulas."""
    kinds = dict(df.dtypes)
    cells = [guarded(F.col(c)).alias(c) if guard and kinds[c] == "string" else F.col(c) for c in df.columns]
    df.select(*cells).write.mode("overwrite").option("header", "true").option("lineSep", "\n").csv(path)


def write_jsonl(df: DataFrame, path: str, layout: bool = True) -> None:
    df = df if layout or "layout" not in df.columns else df.drop("layout")
    df.write.mode("overwrite").json(path)


def write_ordered(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines sorted over all parts (parts in name order)."""
    df.orderBy(*order).write.mode("overwrite").json(path)
