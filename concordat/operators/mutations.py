"""Errors planted into cited invoices, and how many of them the rules and the page tell.

A mutation changes a document the way a misreading or an invention would, and leaves its
citations as they are unless it invents them too. Every document gives one row for each kind
that applies to it; the rules of invoices and of cited values then run over all of them, and
a mutation counts as caught by what they find beyond what they find in the document itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions import dates, text
from concordat.functions.bind import let
from concordat.operators import citations, validation

MONEY = "decimal(18,2)"
#: A plausible name that no page prints.
OTHER_PARTY = "Northgate Supplies Ltd"
AMOUNTS = ("subtotal", "tax_amount", "total_amount")
FIELDS = ("invoice_number", "issue_date", "seller.name", *AMOUNTS)
#: The column of each cited field.
FIELD_COLUMNS = {"invoice_number": "number", "issue_date": "issue_date", "seller.name": "seller"} | {c: c for c in AMOUNTS}


def turned(s: Column, at: Column, by: int, never_zero: bool = False) -> Column:
    """``s`` with the digit at place ``at`` (from 1) raised by ``by`` modulo 10."""
    digit = F.pmod(F.substr(s, at, F.lit(1)).cast("int") + by, F.lit(10))
    digit = F.when(digit == 0, 1).otherwise(digit) if never_zero else digit
    return F.concat(F.substr(s, F.lit(1), at - 1), digit.cast("string"), F.substr(s, at + 1))


def errors() -> dict[str, tuple[Column, dict[str, Column]]]:
    """By kind: where it applies, and the columns that it changes."""
    number, day, iban, total = F.col("number"), F.col("issue_date"), F.regexp_replace("iban", " ", ""), F.col("total_amount").cast(MONEY)
    sub, tax = F.col("subtotal").cast(MONEY), F.col("tax_amount").cast(MONEY)
    printed = total.cast("string")
    swap = F.make_date(F.year(day), F.dayofmonth(day), F.month(day))
    last = F.length(number) - F.length(F.regexp_extract(number, r"[0-9]([^0-9]*)$", 1))
    invented = (total + 41).cast(MONEY)
    return {
        "digit_in_total": (printed.rlike("[1-9]"), {"total_amount": turned(printed, F.regexp_instr(printed, F.lit("[1-9]")), 3, never_zero=True).cast(MONEY)}),
        "consistent_inflation": (sub.isNotNull() & total.isNotNull(), {"subtotal": (sub + 100).cast(MONEY), "total_amount": (total + 100).cast(MONEY)}),
        "tax_off": (sub.isNotNull() & tax.isNotNull() & total.isNotNull(), {"tax_amount": (tax + F.lit("7.50").cast(MONEY)).cast(MONEY)}),
        "day_month_swap": ((F.dayofmonth(day) <= 12) & (F.dayofmonth(day) != F.month(day)), {"issue_date": F.when(F.dayofmonth(day) <= 12, swap)}),
        "wrong_doc_number": (number.rlike("[0-9]"), {"number": F.when(number.rlike("[0-9]"), turned(number, last, 1))}),
        "fabricated_quote": (total.isNotNull(), {"total_amount": invented, "quotes": F.map_concat(F.map_filter("quotes", lambda k, v: k != "total_amount"), F.create_map(F.lit("total_amount"), F.concat(F.lit("TOTAL DUE "), invented)))}),
        "wrong_party": (F.col("seller").isNotNull(), {"seller": F.lit(OTHER_PARTY)}),
        "broken_iban": (F.length(iban) > 10, {"iban": F.when(iban.rlike("[0-9]$"), turned(iban, F.length(iban), 1)).otherwise(F.concat(F.substr(iban, F.lit(1), F.length(iban) - 1), F.lit("0")))}),
    }


def planted(docs: DataFrame, kinds: dict[str, tuple[Column, dict[str, Column]]]) -> DataFrame:
    """``docs`` once for each kind that applies, which ``__m`` holds with the changed columns."""
    changed = sorted({c for _, new in kinds.values() for c in new})
    kind_of = {c: docs.schema[c].dataType for c in changed}
    rows = [F.when(applies, F.struct(F.lit(k).alias("kind"), *[new.get(c, F.col(c)).cast(kind_of[c]).alias(c) for c in changed])) for k, (applies, new) in kinds.items()]
    # An array of its own column is compiled; inside the generator Spark would interpret it.
    return docs.select("*", F.array(*rows).alias("__rows")).select(*docs.columns, F.explode_outer("__rows").alias("__m")).where("__m is not null")


def mutated(docs: DataFrame) -> DataFrame:
    """``docs`` once as they are (kind ``none``) and once for each kind of error that applies.

    docs: doc_id, number, issue_date, seller, iban, subtotal, tax_amount, total_amount, quotes (map of field to quote) and
    any other columns, which stay.
    """
    m = planted(docs, {"none": (F.lit(True), {})} | errors())
    return m.select(*[c for c in docs.columns if c not in m.schema["__m"].dataType.names], "__m.*")


def findings(docs: DataFrame, context: validation.Context = validation.Context()) -> DataFrame:
    """(doc_id, rule, field) of what the rules of invoices and of cited values find; docs as above with page_text and what the rules read."""
    own = validation.issues(docs, "invoice", context).select("doc_id", "rule", "field")
    value = {"invoice_number": F.col("number"), "issue_date": F.col("issue_date").cast("string"), "seller.name": F.col("seller"), **{c: F.col(c).cast("string") for c in ("subtotal", "tax_amount", "total_amount")}}
    cell = lambda f: F.struct(F.lit(f).alias("field"), value[f].alias("value"), F.col("quotes")[f].alias("quote"))
    c = docs.select("doc_id", "page_text", F.explode(F.array(*[cell(f) for f in FIELDS])).alias("c")).select("doc_id", "page_text", "c.*").where("value is not null")
    c = c.withColumn("amount", F.when(F.col("field").isin("subtotal", "tax_amount", "total_amount"), F.col("value").try_cast(MONEY))).withColumn("day", F.when(F.col("field") == "issue_date", F.col("value").try_cast("date")))
    rules = {"quote_on_page": citations.quotes_on_page, "number_printed": citations.cited_numbers, "date_printed": citations.cited_dates, "identifier_printed": citations.cited_identifiers, "name_printed": citations.cited_names}
    out = own
    for name, rule in rules.items():
        out = out.unionByName(rule(c).select("doc_id", F.lit(name).alias("rule"), "field"))
    return out


def reads(docs: DataFrame, column: Column, names: list[str]) -> set[str]:
    """Those of the columns ``names`` that ``column`` is made of."""
    found = docs.select(column)._jdf.queryExecution().analyzed().references().iterator()
    out = set()
    while found.hasNext():
        out.add(found.next().name())
    return out & set(names)


def cell_rules(value: dict[str, Column], quotes: Column, page: Column, order: Column) -> dict[str, dict[str, Column]]:
    """By rule of cited values and by field: whether the field's citation breaks it. ``page``: the page's text as ``text.collapse`` has it, ``order``: its order of day and month."""
    quote, there = (lambda f: quotes[f]), (lambda f: citations.has_quote(quotes[f]))
    amount = lambda f: value[f].try_cast(MONEY)
    day, key = value["issue_date"].try_cast("date"), text.alnum_key(value["invoice_number"])
    names = F.struct(text.core_name(value["seller.name"]).alias("core"), text.normalize(quote("seller.name")).alias("said"))
    other_name = let(names, lambda n: (n["core"] != "") & ~F.contains(n["said"], n["core"]) & ~text.few_misread(n["core"], F.split(n["said"], " ")), "boolean")
    return {
        "quote_on_page": {f: value[f].isNotNull() & there(f) & page.isNotNull() & citations.off_page(quote(f), page) for f in FIELDS},
        "number_printed": {f: there(f) & amount(f).isNotNull() & ~validation.grounded(quote(f), amount(f)) for f in AMOUNTS},
        "date_printed": {"issue_date": there("issue_date") & day.isNotNull() & citations.other_day(day, quote("issue_date"), order)},
        "identifier_printed": {"invoice_number": (F.trim(value["invoice_number"]) != "") & citations.other_identifier(key, quote("invoice_number"))},
        "name_printed": {"seller.name": there("seller.name") & (F.trim(value["seller.name"]) != "") & other_name},
    }


def caught(docs: DataFrame, context: validation.Context = validation.Context()) -> DataFrame:
    """(doc_id, mutation, caught, rules) of every mutation: whether the rules find more than in the document as it is, and which do.

    One pass without a shuffle: a document is judged once as it is and once for each kind, then only by the rules that read what the
    kind changes, as no other rule can find more.
    """
    kinds = errors()
    changed = sorted({c for _, new in kinds.values() for c in new})
    if validation.TABLE_RULES.get("invoice") or any(reads(docs, elements(), changed) for elements, _ in validation.ELEMENT_RULES.get("invoice", [])):
        raise ValueError("mutations are judged by row: no rule of whole tables, and none of elements that a mutation changes")
    # No lambda around the rules: Spark compiles what no lambda holds.
    empty = F.array().cast("array<string>")
    own = {r.name: F.coalesce(r.run(context)["field"], empty) for r in validation.RULES["invoice"]}
    by = {n: reads(docs, c, changed) for n, c in own.items()}
    own = {n: c for n, c in own.items() if by[n]}

    def value(at: Callable[[str], Column]) -> dict[str, Column]:
        return {f: at(c).cast("string") for f, c in FIELD_COLUMNS.items()}

    x = docs.select(*docs.columns, text.collapse(F.col("page_text")).alias("__page"), dates.convention_from_dates(F.coalesce("page_text", F.lit(""))).alias("__order"))
    x = planted(x.withColumn("__before", F.struct(*[c.alias(n) for n, c in own.items()])), kinds)
    x = x.select(*[c for c in docs.columns if c not in changed], "__page", "__order", "__before", *[F.col(c).alias(f"__was_{c}") for c in changed], "__m.*")
    was, now = (cell_rules(value(lambda c, p=p: F.col(p + c)), F.col(f"{p}quotes"), F.col("__page"), F.col("__order")) for p in ("__was_", ""))

    def where(names: set[str], finds: Column) -> Column:
        """``finds`` for the kinds that change one of the columns, else false."""
        touched = [k for k, (_, new) in kinds.items() if names & set(new)]
        return F.when(F.col("kind").isin(*touched), F.coalesce(finds, F.lit(False))).otherwise(False)

    more = {n: [where(by[n], F.size(F.array_except(c, F.col("__before")[n])) > 0)] for n, c in own.items()}
    for n, of in now.items():
        for f, finds in of.items():
            same = F.col(FIELD_COLUMNS[f]).eqNullSafe(F.col(f"__was_{FIELD_COLUMNS[f]}")) & F.col("quotes")[f].eqNullSafe(F.col("__was_quotes")[f])
            names = {"quotes"} if n == "quote_on_page" else {FIELD_COLUMNS[f], "quotes"}
            more.setdefault(n, []).append(where(names, ~same & F.coalesce(finds, F.lit(False)) & ~F.coalesce(was[n][f], F.lit(False))))
    told = F.concat(empty, *[F.when(reduce(or_, more[n]), F.array(F.lit(n))).otherwise(empty) for n in sorted(more)])
    return x.select("doc_id", F.col("kind").alias("mutation"), told.alias("rules")).select("doc_id", "mutation", (F.size("rules") > 0).alias("caught"), "rules")
