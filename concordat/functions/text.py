"""Text keys as columns; Arrow functions only where Unicode folding or similarity ratios need Python."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Legal forms that end a company's name.
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "company", "co", "ltd", "limited", "llc", "llp", "lp", "plc", "sa", "sau", "sl", "slu",
    "sca", "gmbh", "mbh", "bv", "nv", "ag", "as", "oy", "ab", "pte", "pty", "srl", "spa", "sarl", "kg", "ou",
)
# Fixed value: what no company's name is written with.
ILLEGIBLE = r"(?U)[»«¦|~^`¬°{}\[\]<>@#*=\\]|[^\W\d_]:\s*[^\W\d_]"
MIN_TEXT_CHARS, MAX_CID_SHARE = 20, 0.1
MISREAD = 0.2


def normalize(c: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def core_name(c: Column) -> Column:
    """A company's name without its legal form: two single letters at the end are glued, then legal forms dropped.

    A name of legal forms only, or without ASCII letters, becomes empty.
    """
    glued = F.regexp_replace(normalize(c), "(^| )([a-z0-9]) ([a-z0-9])$", "$1$2$3")
    return F.trim(F.regexp_replace(glued, rf"(?:(?:^| )(?:{'|'.join(LEGAL_FORMS)}))+$", ""))


def same_entity(a: Column, b: Column, guarded: bool = True) -> Column:
    """Equal core names; ``guarded`` asks for one that is not empty."""
    same = core_name(a) == core_name(b)
    return same & (core_name(a) != "") if guarded else same


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]", "")


def appears_in(value: Column, normalized_text: Column) -> Column:
    v = normalize(value)
    return (v != "") & F.contains(normalized_text, v)


def label_of(line: Column) -> Column:
    """The wording of a line without its numbers and currency signs."""
    return normalize(F.regexp_replace(line, r"[\d.,%$€£]+", " "))


def illegible(name: Column) -> Column:
    return name.rlike(ILLEGIBLE)


def canon(c: Column) -> Column:
    """Apostrophes away, other punctuation as spaces, white space collapsed, lower case."""
    x = F.regexp_replace(F.lower(c), r"['’`]", "")
    return F.trim(F.regexp_replace(x, r"(?U)[^\w]+", " "))


def collapse(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def quality_ok(text: Column) -> Column:
    """Long enough, and not mostly placeholders of an unreadable font."""
    t = F.coalesce(F.trim(text), F.lit(""))
    marks = F.regexp_count(t, F.lit(r"\(cid:\d+\)"))
    return (F.length(t) >= MIN_TEXT_CHARS) & (marks <= MAX_CID_SHARE * F.length(t))


def page_chunks(pages: Column, limit: int) -> Column:
    """Pages (array of strings) packed in order into chunks of at most ``limit`` characters; a longer page is a chunk."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def add(acc: Column, page: Column) -> Column:
        joined = F.when(acc["open"] == "", page).otherwise(F.concat(acc["open"], F.lit("\n\n"), page))
        full = (acc["open"] != "") & (F.length(joined) > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, page).otherwise(joined).alias("open"),
        )

    return F.aggregate(pages, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Case folded, without combining marks."""
    def one(x: str | None) -> str | None:
        return None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(ch))

    return s.map(one)


@F.pandas_udf(T.StringType())
def stream_form(s: pd.Series) -> pd.Series:
    """Compatibility form, case folded, without white space and column bars: what quotes are looked up in."""
    def one(x: str | None) -> str | None:
        return None if x is None else "".join(unicodedata.normalize("NFKC", x).casefold().replace("|", " ").split())

    return s.map(one)


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with keys in order and fractional numbers to two digits, so that equal values of two runs are equal texts.

    Numbers beyond what a double holds stay as written; null and what is no JSON give null.
    """
    def number(x: str) -> float:
        return round(float(x), 2) + 0.0  # no negative zero

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x, parse_float=number), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return s.map(one)


def few_misread(name: Column, words: Column, between: str = " ") -> Column:
    """Some run of as many ``words`` as the name has, or one more or less, differs from it in at most ``MISREAD`` of the longer one's letters.

    ``name`` has its own words between single spaces. The edit distance is a function of the JVM; runs that are too long or too
    short for it are not measured.
    """
    n = F.size(F.split(name, " "))
    key = F.replace(name, F.lit(" "), F.lit(between))

    def near(run: Column) -> Column:
        room = F.floor(MISREAD * F.greatest(F.length(key), F.length(run)))
        return F.when(F.abs(F.length(key) - F.length(run)) <= room, F.levenshtein(key, run) <= room).otherwise(False)

    sizes = F.sequence(F.greatest(n - 1, F.lit(1)), n + 1)
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda at: F.array_join(F.slice(words, at, k), between))
    return F.coalesce(F.exists(sizes, lambda k: F.exists(runs(k), near)), F.lit(False))


def name_printed(name: Column, line: Column) -> Column:
    """The name stands on the line, case, spaces and punctuation aside, or with a few letters misread."""
    spaced = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), alnum_key), lambda w: w != "")
    own, words = spaced(name), spaced(line)
    key = F.array_join(own, "")
    return (key != "") & (F.contains(F.array_join(words, ""), key) | few_misread(F.array_join(own, " "), words, ""))
