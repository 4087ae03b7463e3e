"""Dates as printed: their readings, the document's convention, plausibility and renderings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from concordat.functions.bind import let

# How dates are printed, in digits, with dots, and the signs of currencies whose users write the day first.
NUMERIC = r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})(?!\d)"
ISO = r"(?<!\d)(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})(?!\d)"
DOTTED = r"(?<![\d.])\d{1,2}\.(\d{1,2})\.(?:\d{4}|\d{2})(?![\d.])"
DAY_FIRST_SIGNS = r"\b(?:RM|MYR|SGD|GBP|EUR|INR)\b|S\$\s?\d|[£€₹]\s?\d|\d\s?[€£]"
EARLIEST = "1990-01-01"
# Month names in English, German, French and Spanish, January first.
MONTHS = (
    "january jan januar janvier enero ene", "february feb februar fevrier février febrero", "march mar märz maerz marz mars marzo",
    "april apr avril abril", "may mai mayo", "june jun juni juin junio", "july jul juli juillet julio", "august aug aout août agosto ago",
    "september sep sept septembre septiembre", "october oct oktober okt octobre octubre", "november nov novembre noviembre",
    "december dec dezember dez decembre décembre diciembre dic",
)
# Dates with a month's name.
WORD = r"([^\W\d_]+)"
DAY_MONTH = r"(?U)(?<!\d)(\d{1,2})(?:st|nd|rd|th)?\.?\s+(?:de\s+)?" + WORD + r"\.?,?\s+(?:de\s+)?(\d{4})(?!\d)"
MONTH_DAY = r"(?U)" + WORD + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)"


def make(y: Column, m: Column, d: Column) -> Column:
    """A date, null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def full_year(y: Column) -> Column:
    n = y.try_cast("int")
    return F.when(F.length(y) == 2, n + F.when(n < 70, 2000).otherwise(1900)).otherwise(n)


def groups(text: Column, pattern: str, n: int) -> Column:
    """array<struct<g1..gn>> of all matches."""
    cols = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)]
    return F.arrays_zip(*cols)


def numeric_readings(text: Column, order: Column | None = None) -> Column:
    """All dates that the numeric dates of a text can mean, under ``order`` ('dmy', 'mdy' or null for both)."""
    order = F.lit(None).cast("string") if order is None else order

    def read(x: Column) -> Column:
        under = lambda o, y, m, d: F.transform(x["found"], lambda g: F.when(F.coalesce(x["order"], F.lit(o)) == o, make(full_year(g[y]), g[m], g[d])))
        return F.concat(under("dmy", "g3", "g2", "g1"), under("mdy", "g3", "g1", "g2"))

    # The order may come from a whole page: it is found once, not for each date.
    numeric = let(F.struct(order.alias("order"), groups(text, NUMERIC, 3).alias("found")), read, "array<date>")
    iso = F.transform(groups(text, ISO, 3), lambda g: make(g["g1"], g["g2"], g["g3"]))
    return F.array_compact(F.array_distinct(F.concat(numeric, iso)))


def named_dates(text: Column) -> Column:
    """Dates written with a month's name."""
    number = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS, 1) for name in names.split() for x in (name, i)])
    t = F.lower(text)
    month = lambda w: F.try_element_at(number, w)
    a = F.transform(groups(t, DAY_MONTH, 3), lambda g: make(g["g3"], month(g["g2"]), g["g1"]))
    b = F.transform(groups(t, MONTH_DAY, 3), lambda g: make(g["g3"], month(g["g1"]), g["g2"]))
    return F.array_compact(F.array_distinct(F.concat(a, b)))


def convention_from_dates(text: Column) -> Column:
    over = lambda g: g.try_cast("int") > 12
    dotted = F.exists(F.regexp_extract_all(text, F.lit(DOTTED), F.lit(1)), lambda m: m.try_cast("int") <= 12)

    def told(x: Column) -> Column:
        return F.struct(F.exists(x, lambda g: over(g["g2"])).alias("month"), (F.exists(x, lambda g: over(g["g1"]) & ~over(g["g2"])) | dotted).alias("day"))

    first = "struct<month:boolean,day:boolean>"
    return let(let(groups(text, NUMERIC, 3), told, first), lambda f: F.when(f["day"] & ~f["month"], "dmy").when(f["month"] & ~f["day"], "mdy"), "string")


def convention_from_currency(text: Column) -> Column:
    return F.when(text.rlike(r"(?<![A-Z])\$\s?\d"), "mdy").when(text.rlike(DAY_FIRST_SIGNS), "dmy")


def convention_from_amounts(text: Column) -> Column:
    return F.when(text.rlike(r"\d,\d{2}(?!\d)") & ~text.rlike(r"\d\.\d{2}(?!\d)"), "dmy")


def convention(text: Column) -> Column:
    """'dmy', 'mdy' or null, from the text's own evidence: its dates, then its currency, then its decimal mark."""
    return F.coalesce(convention_from_dates(text), convention_from_currency(text), convention_from_amounts(text))


def plausible(d: Column, as_of: str, years_ahead: int) -> Column:
    return d.between(F.lit(EARLIEST).cast("date"), F.add_months(F.lit(as_of).cast("date"), 12 * years_ahead))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(a, b))


def renderings(d: Column) -> Column:
    """The ways to print a date, in the normal form of texts."""
    formats = ("yyyy-MM-dd", "dd MM yyyy", "MM dd yyyy", "d MMMM yyyy", "MMMM d yyyy", "d MMM yyyy", "MMM d yyyy", "yyyy MM dd")
    return F.array(*[F.lower(F.date_format(d, f)) for f in formats])


def contradicts(d: Column, text: Column, normalized: Column) -> Column:
    """The text prints the date only under the other convention than its own."""
    own, strong = convention(text), convention_from_dates(text)
    def printed(day_first: bool) -> Column:
        a, b = ("dd", "MM") if day_first else ("MM", "dd")
        short = ("d" if day_first else "M")
        return F.array(*[F.date_format(d, f) for f in (f"{a} {b} yyyy", f"{short} {b} yyyy", f"{a} {b} yy")])
    hit = lambda forms: F.exists(forms, lambda r: F.contains(normalized, r))
    dmy, mdy = hit(printed(True)), hit(printed(False))
    found = F.when(own == "dmy", dmy).otherwise(mdy)
    other = F.when(own == "dmy", mdy).otherwise(dmy)
    clear = F.array_contains(named_dates(text), d) | F.contains(normalized, F.date_format(d, "yyyy MM dd"))
    weak_but_silent = strong.isNull() & ((F.dayofmonth(d) == F.month(d)) | ~other)
    return own.isNotNull() & d.isNotNull() & ~found & ~clear & ~weak_but_silent


def parse_printed(s: Column, order: str = "dmy") -> Column:
    """A printed date under a convention, by the formats in use."""
    numeric = [f"d{m}M{m}{y}" for m in "/.-" for y in ("yyyy", "yy")] if order == "dmy" else [f"M{m}d{m}{y}" for m in "/.-" for y in ("yyyy", "yy")]
    formats = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", *numeric, "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
    return F.coalesce(*[F.try_to_date(F.trim(s), f) for f in formats])
