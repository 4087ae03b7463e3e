"""Check digits as three-valued column predicates: true, false, or null where no rule is known.

Everything is column arithmetic on single digits; a few values that are used often are bound by a one-element array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from concordat.functions.bind import let

# IBAN lengths by country.
IBAN_LENGTHS = {
    "AD": 24, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BR": 29, "BY": 28, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GI": 23, "GL": 18, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "RS": 22, "RU": 33, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}
# Countries that use no IBANs, and the shape of one.
WITHOUT_IBAN = ("US", "CA")
IBAN_SHAPE = r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"
# VAT number bodies by prefix.
VAT_FORMATS = {
    "AT": r"U\d{8}", "BE": r"[01]\d{9}", "BG": r"\d{9,10}", "CHE": r"\d{9}(?:MWST|TVA|IVA)?", "CY": r"\d{8}[A-Z]", "CZ": r"\d{8,10}",
    "DE": r"\d{9}", "DK": r"\d{8}", "EE": r"\d{9}", "EL": r"\d{9}", "ES": r"[0-9A-Z]\d{7}[0-9A-Z]", "FI": r"\d{8}",
    "FR": r"[0-9A-HJ-NP-Z]{2}\d{9}", "GB": r"\d{9}|\d{12}|GD\d{3}|HA\d{3}", "HR": r"\d{11}", "HU": r"\d{8}",
    "IE": r"\d{7}[A-W][A-I]?|\d[A-Z+*]\d{5}[A-W]", "IT": r"\d{11}", "LT": r"\d{9}|\d{12}", "LU": r"\d{8}", "LV": r"\d{11}", "MT": r"\d{8}",
    "NL": r"\d{9}B\d{2}", "NO": r"\d{9}(?:MVA)?", "PL": r"\d{10}", "PT": r"\d{9}", "RO": r"\d{2,10}", "SE": r"\d{12}", "SI": r"\d{8}",
    "SK": r"\d{10}", "XI": r"\d{9}|\d{12}|GD\d{3}|HA\d{3}",
}
# First two digits of an EIN that are never issued, besides 00.
EIN_UNUSED = (7, 8, 9, 17, 18, 19, 28, 29, 49, 69, 70, 78, 79, 89)
#: Countries whose tax number is the VAT number without its prefix, and those of them with one format for all.
BARE_COUNTRIES, ONE_FORMAT = ("PT", "BE", "DK", "ES", "IT", "PL"), ("PT", "BE", "DK", "ES")
DNI_LETTERS, CIF_LETTERS, IE_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE", "JABCDEFGHI", "WABCDEFGHIJKLMNOPQRSTUV"


def digit(s: Column, i: int) -> Column:
    """The i-th character (from 1) as a number, null if it is none."""
    return F.substring(s, i, 1).try_cast("int")


def number(s: Column, start: int, n: int) -> Column:
    return F.substring(s, start, n).try_cast("bigint")


def weighted(s: Column, weights: Sequence[int], start: int = 1) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(s, start + i) * w
    return total


def digit_sum(x: Column) -> Column:
    """Of a number below 100."""
    return F.floor(x / 10).cast("int") + x % 10


def shaped(s: Column, pattern: str, verdict: Column) -> Column:
    """False unless the whole string has the pattern; then the verdict."""
    return F.when(s.rlike(f"^(?:{pattern})$"), verdict).otherwise(F.lit(False))


def letter_at(letters: str, i: Column) -> Column:
    return F.substr(F.lit(letters), (i + 1).cast("int"), F.lit(1))


def compact(s: Column) -> Column:
    return F.upper(F.regexp_replace(s, r"[ .\-]", ""))


def iban_compact(s: Column) -> Column:
    return F.upper(F.replace(s, F.lit(" "), F.lit("")))


def iban_shaped(iban: Column) -> Column:
    return iban_compact(iban).rlike(IBAN_SHAPE)


def iban_valid(iban: Column) -> Column:
    """Shape, the country's length, and ISO 7064 MOD 97-10: letters become two digits, the remainder is that of decimals."""
    s = iban_compact(iban)
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    for i, letter in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        turned = F.replace(turned, F.lit(letter), F.lit(str(10 + i)))
    # Up to 68 digits, 17 at a time: the remainder so far leads the next run.
    rest = F.lit("0")
    for k in range(4):
        rest = (F.concat(rest, F.substring(turned, 17 * k + 1, 17)).try_cast("decimal(19,0)") % 97).cast("int").cast("string")
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    country = F.substring(s, 1, 2)
    fits = F.coalesce(F.try_element_at(lengths, country) == F.length(s), F.lit(True))
    return F.when(s.rlike(IBAN_SHAPE) & ~country.isin(*WITHOUT_IBAN) & fits, rest == "1").when(iban.isNotNull(), False)


def luhn(s: Column) -> Column:
    return F.when(s.rlike(r"^\d+$"), F.call_function("luhn_check", s)).otherwise(F.lit(False))


def eleven(s: Column, weights: Sequence[int], at: int, start: int = 1) -> Column:
    """Check digit 11 - sum mod 11, where 11 becomes 0 and 10 is never issued."""
    check = 11 - weighted(s, weights, start) % 11
    return F.when(check == 10, False).otherwise(F.when(check == 11, 0).otherwise(check) == digit(s, at))


def low_zero(s: Column, weights: Sequence[int], start: int = 1) -> Column:
    """Check digit 0 for remainders 0 and 1, else 11 - remainder."""
    r = weighted(s, weights, start) % 11
    return F.when(r < 2, 0).otherwise(11 - r)


def vat_at(b: Column) -> Column:
    total = F.lit(0)
    for i, w in enumerate((1, 2, 1, 2, 1, 2, 1)):
        total = total + digit_sum(digit(b, 2 + i) * w)
    return shaped(b, r"U\d{8}", (10 - (total + 4) % 10) % 10 == digit(b, 9))


def vat_be(b: Column) -> Column:
    return shaped(b, r"[01]\d{9}", 97 - number(b, 1, 8) % 97 == number(b, 9, 2))


def vat_ch(b: Column) -> Column:
    return shaped(b, r"\d{9}(?:MWST|TVA|IVA)?", eleven(b, (5, 4, 3, 2, 7, 6, 5, 4), 9))


def vat_de(b: Column) -> Column:
    product = F.lit(10)
    for i in range(1, 9):
        # A sum of 0 counts as 10; written so that the term stands once in each step.
        product = (2 * ((digit(b, i) + product + 9) % 10 + 1)) % 11
    return shaped(b, r"\d{9}", (11 - product) % 10 == digit(b, 9))


def vat_dk(b: Column) -> Column:
    return shaped(b, r"\d{8}", weighted(b, (2, 7, 6, 5, 4, 3, 2, 1)) % 11 == 0)


def vat_es(b: Column) -> Column:
    first, last = F.substring(b, 1, 1), F.substring(b, 9, 1)
    lead = F.when(first == "X", 0).when(first == "Y", 1).otherwise(2)
    by_letter = lambda n: last == letter_at(DNI_LETTERS, n % 23)
    odd = F.lit(0)
    for i in (2, 4, 6, 8):
        odd = odd + digit_sum(digit(b, i) * 2)
    control = (10 - (odd + digit(b, 3) + digit(b, 5) + digit(b, 7)) % 10) % 10
    as_letter, as_digit = last == letter_at(CIF_LETTERS, control), last == control.cast("string")
    company = F.when(first.isin(*"PQRSNW"), as_letter).when(first.isin(*"ABEH"), as_digit).otherwise(as_letter | as_digit)
    return (
        F.when(F.length(b) != 9, False)
        .when(b.rlike(r"^[XYZ]\d{7}"), by_letter(lead * 10000000 + number(b, 2, 7)))
        .when(b.rlike(r"^\d{8}"), by_letter(number(b, 1, 8)))
        .when(b.rlike(r"^.\d{7}"), company)
        .otherwise(False)
    )


def vat_fi(b: Column) -> Column:
    r = weighted(b, (7, 9, 10, 5, 8, 4, 2)) % 11
    return shaped(b, r"\d{8}", F.when(r == 1, False).otherwise(F.when(r == 0, 0).otherwise(11 - r) == digit(b, 8)))


def vat_fr(b: Column) -> Column:
    return shaped(b, r"\d{11}", number(b, 1, 2) == (12 + 3 * (number(b, 3, 9) % 97)) % 97)


def vat_gb(b: Column) -> Column:
    total = weighted(b, range(8, 1, -1)) + number(b, 8, 2)
    return shaped(b, r"\d{9}", (total % 97 == 0) | (F.pmod(total - 55, F.lit(97)) == 0))


def vat_ie(b: Column) -> Column:
    seven = weighted(b, range(8, 1, -1))
    second = F.when(F.length(b) == 9, F.greatest(F.position(F.substring(b, 9, 1), F.lit(IE_LETTERS)) - 1, F.lit(0)) * 9).otherwise(0)
    return shaped(b, r"\d{7}[A-Z]{1,2}", F.substring(b, 8, 1) == letter_at(IE_LETTERS, (seven + second) % 23))


def vat_it(b: Column) -> Column:
    total = F.lit(0)
    for i in range(1, 11):
        total = total + (digit(b, i) if i % 2 else digit_sum(digit(b, i) * 2))
    return shaped(b, r"\d{11}", (10 - total % 10) % 10 == digit(b, 11))


def vat_lu(b: Column) -> Column:
    return shaped(b, r"\d{8}", number(b, 1, 6) % 89 == number(b, 7, 2))


def vat_nl(b: Column) -> Column:
    check = weighted(b, range(9, 1, -1)) % 11
    return shaped(b, r"\d{9}(?:B\d{2})?", F.when(check == 10, 0).otherwise(check) == digit(b, 9))


def vat_no(b: Column) -> Column:
    return shaped(b, r"\d{9}(?:MVA)?", eleven(b, (3, 2, 7, 6, 5, 4, 3, 2), 9))


def vat_pl(b: Column) -> Column:
    check = weighted(b, (6, 5, 7, 2, 3, 4, 5, 6, 7)) % 11
    return shaped(b, r"\d{10}", (check != 10) & (check == digit(b, 10)))


def vat_pt(b: Column) -> Column:
    return shaped(b, r"\d{9}", low_zero(b, range(9, 1, -1)) == digit(b, 9))


def vat_se(b: Column) -> Column:
    return shaped(b, r"\d{10}01", luhn(F.substring(b, 1, 10)))


VAT_CHECKERS: dict[str, Callable[[Column], Column]] = {
    "AT": vat_at, "BE": vat_be, "CHE": vat_ch, "DE": vat_de, "DK": vat_dk, "ES": vat_es, "FI": vat_fi, "FR": vat_fr, "GB": vat_gb,
    "IE": vat_ie, "IT": vat_it, "LU": vat_lu, "NL": vat_nl, "NO": vat_no, "PL": vat_pl, "PT": vat_pt, "SE": vat_se,
}
# Fixed value: prefix and body of a VAT number.
VAT_SHAPE = r"^(CHE|[A-Z]{2})([0-9A-Z]{2,14})$"


def by_prefix(vat: Column, verdicts: dict[str, Callable[[Column], Column]]) -> Column:
    """False where the value is not shaped like a VAT number, null where no verdict is known for its prefix."""

    def judge(x: Column) -> Column:
        out = F.when(x["prefix"] == "", False)
        for p, f in verdicts.items():
            out = out.when(x["prefix"] == p, F.coalesce(f(x["body"]), F.lit(False)))
        return out

    parts = lambda s: F.struct(F.regexp_extract(s, VAT_SHAPE, 1).alias("prefix"), F.regexp_extract(s, VAT_SHAPE, 2).alias("body"))
    return F.when(vat.isNotNull(), let(let(compact(vat), parts), judge))


def vat_format(vat: Column) -> Column:
    return by_prefix(vat, {p: lambda b, f=fmt: b.rlike(f"^(?:{f})$") for p, fmt in VAT_FORMATS.items()})


def vat_valid(vat: Column) -> Column:
    return by_prefix(vat, VAT_CHECKERS)


def ein_valid(ein: Column) -> Column:
    s = F.trim(ein)
    return s.rlike(r"^\d{2}-?\d{7}$") & ~F.coalesce(number(s, 1, 2), F.lit(0)).isin(0, *EIN_UNUSED)


def ca_bn_valid(bn: Column) -> Column:
    s = F.upper(F.regexp_replace(bn, r"\s", ""))
    return shaped(s, r"\d{9}(?:[A-Z]{2}\d{4})?", luhn(F.substring(s, 1, 9)))


def cnpj_valid(value: Column) -> Column:
    one, two = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    right = lambda s: shaped(s, r"(\d)(?!\1{13}$)\d{13}", (low_zero(s, one) == digit(s, 13)) & (low_zero(s, two) == digit(s, 14)))
    return let(F.regexp_replace(value, r"\D", ""), right)


def cpf_valid(value: Column) -> Column:
    right = lambda s: shaped(s, r"(\d)(?!\1{10}$)\d{10}", (low_zero(s, range(10, 1, -1)) == digit(s, 10)) & (low_zero(s, range(11, 1, -1)) == digit(s, 11)))
    return let(F.regexp_replace(value, r"\D", ""), right)


def tax_id(value: Column, country: Column | None = None) -> Column:
    """struct<valid, scheme> by shape and country hint; both null where no national scheme is meant."""
    s, hint = F.trim(value), F.upper(country) if country is not None else F.lit(None).cast("string")
    n = F.length(F.regexp_replace(s, r"\D", ""))
    found = lambda ok, name: F.struct(ok.alias("valid"), F.lit(name).alias("scheme"))
    bn = s.rlike(r"(?i)^\d{9}\s*[A-Z]{2}\s*\d{4}$")
    return (
        F.when(s.rlike(r"^\d{2}-\d{7}$") | ((hint == "US") & s.rlike(r"^\d{9}$")), found(ein_valid(s), "US EIN"))
        .when(bn | ((hint == "CA") & s.rlike(r"^\d{9}$")), found(ca_bn_valid(s), "Canadian BN"))
        .when(((hint == "BR") & (n == 14)) | s.rlike(r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$"), found(cnpj_valid(s), "Brazilian CNPJ"))
        .when(((hint == "BR") & (n == 11)) | s.rlike(r"^\d{3}\.\d{3}\.\d{3}-\d{2}$"), found(cpf_valid(s), "Brazilian CPF"))
        .otherwise(F.struct(F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("scheme")))
    )


def bare_number_ok(value: Column, country: Column) -> Column:
    """A national number that is the VAT number without its prefix, for the countries where the two are one; else null.

    Where companies and people share one format, another shape is wrong; elsewhere it says nothing.
    """
    s, c = F.upper(F.regexp_replace(value, r"[\s.\-/]", "")), F.upper(country)
    body = F.when(s.startswith(c), F.substring(s, 3, 20)).otherwise(s)
    out = F.when(~s.rlike(r"^[\p{L}\p{N}]+$"), F.lit(None).cast("boolean"))
    for p in BARE_COUNTRIES:
        valid = F.when(body.rlike(f"^(?:{VAT_FORMATS[p]})$"), F.coalesce(VAT_CHECKERS[p](body), F.lit(False)))
        out = out.when(c == p, valid.otherwise(False) if p in ONE_FORMAT else valid)
    return out


def bic_valid(bic: Column) -> Column:
    return iban_compact(bic).rlike(r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$")
