"""Flat exports of nested results, the semantic model of an invoice, and guards of the sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from concordat.functions import money

SUMMARY = ("number", "issue_date", "counterparty", "currency", "subtotal", "tax", "total", "reference")
LINE = ("description", "quantity", "unit_price", "total", "sku", "unit_of_measure", "tax_rate_percent")
# Units as printed and their UN/ECE Recommendation 20 codes.
UNITS = {
    "pcs": "C62", "pc": "C62", "piece": "C62", "pieces": "C62", "unit": "C62", "units": "C62", "ea": "C62", "each": "C62", "stk": "C62",
    "stück": "C62", "st": "C62", "x": "C62", "h": "HUR", "hr": "HUR", "hrs": "HUR", "hour": "HUR", "hours": "HUR", "std": "HUR", "day": "DAY",
    "days": "DAY", "month": "MON", "months": "MON", "year": "ANN", "week": "WEE", "kg": "KGM", "g": "GRM", "t": "TNE", "m": "MTR", "km": "KMT",
    "cm": "CMT", "m2": "MTK", "m3": "MTQ", "l": "LTR", "litre": "LTR", "liter": "LTR", "kwh": "KWH", "set": "SET", "pack": "PK", "box": "BX",
    "pallet": "PF", "pallets": "PF", "lump sum": "LS", "ls": "LS",
}
# Identifiers of the six e-invoice profiles (name, syntax, specification, process).
PEPPOL = "urn:fdc:peppol.eu:2017:poacc:billing:01:1.0"
PROFILES = (
    ("en16931", "ubl", "urn:cen.eu:en16931:2017", None),
    ("peppol", "ubl", "urn:cen.eu:en16931:2017#compliant#urn:fdc:peppol.eu:2017:poacc:billing:3.0", PEPPOL),
    ("xrechnung-ubl", "ubl", "urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0", PEPPOL),
    ("xrechnung-cii", "cii", "urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0", PEPPOL),
    ("factur-x-en16931", "cii", "urn:cen.eu:en16931:2017", None),
    ("factur-x-basic", "cii", "urn:cen.eu:en16931:2017#compliant#urn:factur-x.eu:1p0:basic", None),
)
PART = 16_000


def cell(c: Column, kind: str = "string") -> Column:
    """A value as a cell: null as empty, booleans in words, structs and arrays as JSON."""
    if kind.startswith(("struct", "array", "map")):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def guarded(c: Column) -> Column:
    """No spreadsheet takes the cell for a formula."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def summary_rows(results: DataFrame, paths: dict[str, str], issues: str = "issues", reasons: str = "reasons") -> DataFrame:
    """One row a result: its fixed columns, reasons in one cell, counts of issues, and the mapped summary columns."""
    fixed = [c for c in ("source", "document_id", "document_type", "schema_id", "schema_version", "status") if c in results.columns]
    count = lambda s: F.size(F.filter(issues, lambda i: i["severity"] == s)).cast("long")
    kinds = dict(results.dtypes)
    return results.select(
        *fixed, F.array_join(reasons, " | ").alias("review_reasons"), count("error").alias("validation_error_count"), count("warning").alias("validation_warning_count"),
        *[cell(F.col(paths[c]), kinds.get(paths[c], "string")).alias(c) if c in paths else F.lit("").alias(c) for c in SUMMARY],
    )


def line_item_rows(results: DataFrame, items: str, columns: dict[str, str], key: str = "document_id") -> DataFrame:
    """Rows of a repeated list, numbered from 1."""
    x = results.select(key, F.posexplode(items).alias("pos", "item"))
    return x.select(key, (F.col("pos") + 1).alias("line_no"), *[cell(F.col(f"item.{columns[c]}")).alias(c) if c in columns else F.lit("").alias(c) for c in LINE])


def export_gate(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to export, refused with the reason): only results that succeeded leave."""
    why = F.when(F.col("status") == "failed", "invalid").when(F.col("status") == "needs_review", "needs review")
    return results.where("status = 'succeeded'"), results.where("status <> 'succeeded' or status is null").withColumn("refusal", F.coalesce(why, F.lit("unknown status")))


class Exporters:
    """Ways out by name: each takes the results that may leave and gives what is written. The gate is the same for all."""

    def __init__(self) -> None:
        self.writers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, write: Callable[[DataFrame], DataFrame], *, replace: bool = False) -> None:
        if name in self.writers and not replace:
            raise ValueError(f"an exporter {name!r} is there already")
        self.writers[name] = write

    def names(self) -> list[str]:
        return sorted(self.writers)

    def run(self, results: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(what the exporter gives, refused results with the reason)."""
        if name not in self.writers:
            raise ValueError(f"no exporter {name!r}; there are {', '.join(self.names())}")
        good, refused = export_gate(results)
        return self.writers[name](good), refused


def unit_code(unit: Column) -> Column:
    u = F.trim(F.coalesce(unit, F.lit("")))
    pairs = [F.lit(x) for name, code in UNITS.items() for x in (name, code)]
    known = F.try_element_at(F.create_map(*pairs), F.regexp_replace(F.lower(u), r"\.+$", ""))
    return F.when(u.rlike("^[A-Z0-9]{2,3}$"), u).otherwise(F.coalesce(known, F.lit("C62")))


def implied_rate(stated: Column, subtotal: Column, discount: Column, shipping: Column, tax: Column) -> Column:
    """The VAT rate: as stated, 0 without tax, else what reproduces the tax to the cent; null where none does."""
    base = money.cents(subtotal) - money.cents(discount) + money.cents(shipping)
    rate = F.round(F.try_divide(money.cents(tax), base) * 100, 2).cast("decimal(8,2)")
    return F.when(stated.isNotNull(), stated.cast("decimal(8,2)")).when(tax == 0, F.lit(0).cast("decimal(8,2)")).when(money.cents(base * rate / 100) == money.cents(tax), rate)


def vat_breakdown(lines: DataFrame, key: str = "id") -> DataFrame:
    """Taxable amount and tax by document, category and rate (columns net, rate)."""
    category = F.when(F.col("rate") > 0, "S").otherwise("Z")
    g = lines.groupBy(key, category.alias("category"), "rate").agg(F.sum("net").cast("decimal(18,2)").alias("taxable"))
    return g.withColumn("tax", money.cents(F.col("taxable") * F.col("rate") / 100))


def semantic_totals(headers: DataFrame, groups: DataFrame, lines: DataFrame, key: str = "id") -> DataFrame:
    """Totals of the semantic model, and why a document cannot be one (null where it can).

    headers: key, subtotal, tax, discount, shipping. Refusals: no line, a line without a rate,
    a document discount over several rates, taxes that do not add up, lines that do not.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    l = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("net").cast("decimal(18,2)").alias("line_total"), F.count_if(F.col("rate").isNull()).alias("rateless"))
    g = groups.groupBy(key).agg(F.count(F.lit(1)).alias("rates"), F.sum("tax").cast("decimal(18,2)").alias("tax_sum"), F.first("rate").alias("rate"))
    x = headers.join(l, key, "left").join(g, key, "left").withColumn("discount", F.coalesce("discount", zero)).withColumn("shipping", F.coalesce("shipping", zero))
    exclusive = (F.col("line_total") - F.col("discount") + F.col("shipping")).cast("decimal(18,2)")
    single = money.cents(exclusive * F.col("rate") / 100)
    refusal = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "BR-16").when(F.col("rateless") > 0, "BR-S-05")
        .when((F.col("rates") > 1) & ((F.col("discount") != 0) | (F.col("shipping") != 0)), "mixed rates")
        .when((F.col("rates") == 1) & (F.abs(single - F.col("tax")) > F.lit("0.01").cast("decimal(4,2)")), "tax")
        .when((F.col("rates") > 1) & (F.col("tax_sum") != F.col("tax")), "tax")
        .when(~money.close(F.col("line_total"), F.col("subtotal")), "BR-CO-10")
    )
    return x.select(key, "line_total", exclusive.alias("tax_exclusive"), (exclusive + F.col("tax")).cast("decimal(18,2)").alias("payable"), refusal.alias("refusal"))


def vat_number(ids: Column) -> Column:
    return F.get(F.filter(ids, lambda t: t["scheme"] == "vat"), F.lit(0))["value"]


def address_line(a: Column) -> Column:
    part = lambda c: F.nullif(F.trim(a[c]), F.lit(""))
    return F.concat_ws(", ", part("street"), part("additional_line"), F.concat_ws(" ", part("postal_code"), part("city")), part("region"), part("country_code"))


def flatten_json(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, path, type, part, value) of all leaves of a JSON text; paths are JSON pointers, long texts come in parts."""
    def kind_of(v: object) -> str:
        return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"

    def walk(v: object, path: str):
        children = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else None
        if children is None or not v:
            yield path, "object" if v == {} else "array" if v == [] else kind_of(v), v
            return
        for k, x in children:
            yield from walk(x, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")

    def rows(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[column], strict=True):
                if t is None:
                    continue
                for path, kind, v in walk(json.loads(t), ""):
                    s = "" if v is None or v in ({}, []) else v if isinstance(v, str) else json.dumps(v)
                    out += [(k, path, kind, i // PART, s[i : i + PART]) for i in range(0, max(len(s), 1), PART)]
            yield pd.DataFrame(out, columns=[key, "path", "type", "part", "value"])

    return df.select(key, column).mapInPandas(rows, f"{key} {df.schema[key].dataType.simpleString()}, path string, type string, part int, value string")
