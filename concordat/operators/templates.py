"""Vendor templates: rules that read known issuers' pages without a model.

Templates and their rules are small tables that the caller holds in code; matching is one
projection of patterns, so pages are neither copied for each template nor joined to all of
them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions import dates, money


class Field(NamedTuple):
    name: str
    label: str
    value: str
    lines_after: int = 0
    kind: str = "text"


class Template(NamedTuple):
    name: str
    issuer: tuple[str, ...]
    fields: tuple[Field, ...] = ()


def which(page: Column, templates: tuple[Template, ...]) -> Column:
    """Name of the first template all of whose issuer patterns stand on the page, else null."""
    out = F.lit(None).cast("string")
    for t in reversed(templates):
        hit = F.lit(True)
        for p in t.issuer:
            hit = hit & page.rlike(f"(?iU){p}")
        out = F.when(hit, t.name).otherwise(out)
    return out


def typed(s: Column, kind: str) -> Column:
    """The value as its kind would be printed; what does not convert stays text."""
    if kind == "amount":
        return F.coalesce(money.parse_amount(s).cast("string"), s)
    if kind == "date":
        return F.coalesce(dates.parse_printed(s).cast("string"), s)
    return F.trim(s)


def read_field(page: Column, f: Field) -> Column:
    """The first value within ``lines_after`` lines from the first line with the label."""
    lines = F.split(page, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(f"(?iU){f.label}")), True)
    window = F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.lit(f.lines_after + 1))
    found = F.filter(F.transform(window, lambda x: F.regexp_extract(x, f.value, 1)), lambda x: x != "")
    return F.when(at > 0, typed(F.get(found, F.lit(0)), f.kind))


def extract(pages: DataFrame, templates: tuple[Template, ...], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, template, field, value) of pages that a template fits; a field that is not found is left out."""
    x = pages.select(key, F.col(text).alias("__text"), which(F.col(text), templates).alias("template")).where("template is not null")
    entries = lambda t: F.array(*[F.struct(F.lit(f.name).alias("field"), read_field(F.col("__text"), f).alias("value")) for f in t.fields])
    chosen = None
    for t in templates:
        if t.fields:
            chosen = F.when(F.col("template") == t.name, entries(t)) if chosen is None else chosen.when(F.col("template") == t.name, entries(t))
    return x.select(key, "template", F.explode(F.filter(chosen, lambda e: e["value"].isNotNull())).alias("e")).select(key, "template", "e.*")


def table_rows(cells: DataFrame, columns: dict[int, tuple[str, str]], by: list[str]) -> DataFrame:
    """Items of grid rows: a row counts only if every mapped cell has its kind ('text' or 'amount')."""
    cell = lambda c: F.max(F.when(F.col("col") == c, F.col("text")))
    wide = cells.groupBy(*by, "row").agg(*[cell(c).alias(n) for c, (n, _) in columns.items()])
    for name, kind in columns.values():
        wide = wide.withColumn(name, money.parse_amount(F.col(name)) if kind == "amount" else F.nullif(F.trim(name), F.lit("")))
    good = F.lit(True)
    for name, _ in columns.values():
        good = good & F.col(name).isNotNull()
    return wide.where(good)
