"""Amounts as printed, and comparisons of amounts in decimals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from concordat.functions.bind import let

AMOUNT = "decimal(28,6)"
# What counts as a number, a percentage and a quantity on a line.
NUMBER = r"(?U)(?<![\w.,])(\d[\d.,]*\d|\d)(?![\w])"
PERCENT = r"(\d+(?:[.,]\d+)?)\s*%"
QUANTITY = r"(?<![\d.,])-?\d+(?:[.,]\d+)?(?!\d)"
SPACES = " \u00a0\u202f\u2009"
GROUPED = rf"(?<![\w.,])\d{{1,3}}(?:[{SPACES}]\d{{3}})+(?:[.,]\d{{1,2}})?(?!\w|[.,]\d)"


def parse_amount(token: Column) -> Column:
    """A printed amount as a decimal, null if it is none.

    With both marks the later one is decimal. A mark that repeats groups; a single one groups
    if exactly three digits follow, else it is decimal.
    """
    no = lambda s, m: F.replace(s, F.lit(m), F.lit(""))

    def read(t: Column) -> Column:
        dots, commas = (F.length(t) - F.length(no(t, m)) for m in ".,")
        last = lambda m: F.length(F.substring_index(t, m, -1))
        one = lambda m: F.when(last(m) == 3, no(t, m)).otherwise(F.replace(t, F.lit(m), F.lit(".")))
        plain = (
            F.when((dots > 0) & (commas > 0), F.when(last(".") < last(","), no(t, ",")).otherwise(F.replace(no(t, "."), F.lit(","), F.lit("."))))
            .when(dots > 1, no(t, ".")).when(commas > 1, no(t, ",")).when(dots == 1, one(".")).when(commas == 1, one(",")).otherwise(t)
        )
        return F.when(t.rlike(r"^\d(?:[\d.,]*\d)?$"), plain.try_cast(AMOUNT))

    return let(F.regexp_replace(F.trim(token), "[ \u00a0]", ""), read, AMOUNT)


def amounts_in(text: Column) -> Column:
    """All amounts of a text in order; tokens that do not parse are left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), parse_amount), lambda x: x.isNotNull())


def percents_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast(AMOUNT))


def quantities_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast(AMOUNT))


def token_value(token: str) -> float | None:
    t = re.sub("[ \u00a0]", "", token.strip())
    if not re.fullmatch(r"\d(?:[\d.,]*\d)?", t):
        return None
    marks = {m: t.count(m) for m in ".," if m in t}
    if len(marks) == 2:
        decimal = max(".,", key=t.rindex)
        t = t.replace("," if decimal == "." else ".", "").replace(decimal, ".")
    elif marks:
        (m, n), = marks.items()
        t = t.replace(m, "" if n > 1 or len(t.rpartition(m)[2]) == 3 else ".")
    try:
        return float(t)
    except ValueError:
        return None


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("value", T.DoubleType())])))
def readings_in(text: pd.Series) -> pd.Series:
    """All readings with their offsets: each token, numbers grouped by spaces as one, and negatives by parentheses or a minus."""
    number, grouped = re.compile(NUMBER.removeprefix("(?U)")), re.compile(GROUPED)

    def one(t: str | None) -> list[dict]:
        out = []
        for m in number.finditer(t or ""):
            v = token_value(m[1])
            if v is None:
                continue
            out.append({"offset": m.start(), "value": v})
            before, after = t[: m.start()].rstrip(SPACES + "$€£"), t[m.end() :].lstrip(SPACES)
            if v and (before.endswith(("-", "−")) or (before.endswith("(") and after.startswith(")"))):
                out.append({"offset": m.start(), "value": -v})
        for m in grouped.finditer(t or ""):
            v = token_value(re.sub(f"[{SPACES}]", "", m[0]))
            if v is not None:
                out.append({"offset": m.start(), "value": v})
        return out

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def amounts_on_line(line: pd.Series) -> pd.Series:
    """Readings outside percentages."""
    read = readings_in.func(line)
    percent = re.compile(r"\d+(?:[.,]\d+)?\s*%")

    def one(t: str | None, rs: list[dict]) -> list[float]:
        spans = [m.span() for m in percent.finditer(t or "")]
        return [r["value"] for r in rs if not any(a <= r["offset"] < b for a, b in spans)]

    return pd.Series([one(t, r) for t, r in zip(line, read, strict=True)])


def close(a: Column, b: Column, tolerance: str = "0.01") -> Column:
    """Equal within an absolute tolerance; on decimals no room for rounding is needed."""
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(18,6)")


def exceeds(a: Column, b: Column, percent: float = 0.0, tolerance: str = "0.01") -> Column:
    """More than b by the allowed percentage, and not merely within the tolerance of it."""
    allowed = b if not percent else b * F.lit(str(1 + percent / 100)).cast("decimal(10,6)")
    return (a > allowed) & ~close(a, b, tolerance)


def line_explained(quantity: Column, price: Column, total: Column, discounts: Column, rates: Column) -> Column:
    """Quantity times price gives the line's total: plainly, within half a cent a unit, after a row discount, or with a tax rate on top."""
    base, target = F.abs(quantity * price), F.abs(total)
    half = F.abs(quantity) * F.lit("0.005").cast("decimal(6,3)")
    return (
        close(base, target) | (F.abs(base - target) <= half)
        | F.exists(discounts, lambda d: (d > 0) & (d < 100) & close(base * (100 - d) / 100, target))
        | F.exists(rates, lambda r: (r > 0) & close(base * (100 + r) / 100, target))
    )


def digit_signature(value: Column) -> Column:
    """The digits of a number wherever its point is; zeros at both ends do not count."""
    digits = F.regexp_replace(F.abs(value).cast("decimal(28,4)").cast("string"), r"\.", "")
    core = F.regexp_replace(digits, "^0+|0+$", "")
    return F.when(core == "", "0").otherwise(core)


def cents(value: Column) -> Column:
    """Rounded half up to cents."""
    return F.round(value.cast("decimal(28,6)"), 2).cast("decimal(18,2)")


def digit_forms(value: Column) -> Column:
    return F.regexp_replace(F.abs(value).cast("decimal(28,2)").cast("string"), r"\D", "")
