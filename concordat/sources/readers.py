"""Where documents come from: files, form-feed pages, vendor JSON, earlier results, e-invoice XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Suffixes by kind of document.
SUFFIXES = {"pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "text": ("txt", "md")}
MAX_FILE_BYTES = 50 * 1024 * 1024


def format_of(path: Column) -> Column:
    """'pdf', 'image', 'text', or null for what is not supported."""
    suffix = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    out = None
    for kind, names in SUFFIXES.items():
        out = F.when(suffix.isin(*names), kind) if out is None else out.when(suffix.isin(*names), kind)
    return out


def content_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 20))


def scan(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, most_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): supported files with format and content id, and the others with the reason.

    Size and name are judged before any content is read: both are predicates of the source.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.withColumn("format", format_of(F.col("path")))
    why = F.when(F.col("format").isNull(), "unsupported_document").when(F.col("length") > most_bytes, "file_too_large")
    good = files.where(F.col("format").isNotNull() & (F.col("length") <= most_bytes)).withColumn("document_id", content_id(F.col("content")))
    bad = files.where(F.col("format").isNull() | (F.col("length") > most_bytes)).select("path", "length", why.alias("reason"))
    return good, bad


def text_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """Pages of text files, split at form feeds and numbered from 1."""
    t = F.decode(F.col(content), "utf-8")
    return files.select(*[c for c in files.columns if c != content], F.posexplode(F.split(t, "\f")).alias("pos", "text")).withColumn("page", F.col("pos") + 1).drop("pos")


def within_page_limit(pages: DataFrame, most: int, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(pages of documents of at most ``most`` pages, the ids of the others)."""
    n = pages.groupBy(key).agg(F.max("page").alias("n"))
    return pages.join(n.where(F.col("n") <= most).select(key), key, "left_semi"), n.where(F.col("n") > most).select(key, F.lit("too_many_pages").alias("reason"))


def vendor_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of JSON lines under a schema; a line is parsed where its result is used."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    bad = F.col("d").isNull() | F.col("d._corrupt_record").isNotNull()
    return rows.where(~bad).select(*[F.col(f"d.{f.name}") for f in schema.fields]), rows.where(bad).select(F.col("value").alias("_corrupt_record"))


def checkpoint_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The last complete row of each source in JSON lines files; a torn line is left out.

    Files follow each other by the time they were written, then by name; lines inside a file by their place, which is
    that of the file's block and then of the row in it.
    """
    at = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(at.alias("at"), "value")
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = lines.withColumn("d", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = lines.where("d is not null and d._corrupt_record is null and d.source is not null")
    last = good.groupBy(F.col("d.source").alias("__source")).agg(F.max_by("d", "at").alias("d"))
    return last.select(*[F.col(f"d.{f.name}") for f in schema.fields])


#: Where each label stands in the two syntaxes, by local names; the first that is there counts.
LABELS = {
    "number": ("/CrossIndustryInvoice/ExchangedDocument/ID", "/Invoice/ID", "/CreditNote/ID"), "currency": ("//InvoiceCurrencyCode", "//DocumentCurrencyCode"),
    "seller": ("//SellerTradeParty/Name", "//AccountingSupplierParty/Party/PartyName/Name", "//AccountingSupplierParty/Party/PartyLegalEntity/RegistrationName"),
    "buyer": ("//BuyerTradeParty/Name", "//AccountingCustomerParty/Party/PartyName/Name", "//AccountingCustomerParty/Party/PartyLegalEntity/RegistrationName"),
    "seller_vat": ("//SellerTradeParty/SpecifiedTaxRegistration/ID[@schemeID='VA']", "//AccountingSupplierParty/Party/PartyTaxScheme[TaxScheme/ID='VAT']/CompanyID"),
    "order_reference": ("//BuyerOrderReferencedDocument/IssuerAssignedID", "/Invoice/OrderReference/ID", "/CreditNote/OrderReference/ID"), "iban": ("//PayeePartyCreditorFinancialAccount/IBANID", "//PaymentMeans[PaymentMeansCode='58']/PayeeFinancialAccount/ID"),
}
AMOUNTS = {
    "line_total": ("//SpecifiedTradeSettlementHeaderMonetarySummation/LineTotalAmount", "//LegalMonetaryTotal/LineExtensionAmount"), "tax": ("//TaxTotalAmount", "/Invoice/TaxTotal/TaxAmount", "/CreditNote/TaxTotal/TaxAmount"),
    "total": ("//GrandTotalAmount", "//LegalMonetaryTotal/TaxInclusiveAmount"),
}


DATES = {
    "issue_cii": ("//IssueDateTime/DateTimeString",), "issue_ubl": ("/Invoice/IssueDate", "/CreditNote/IssueDate"),
    "due_cii": ("//DueDateDateTime/DateTimeString",), "due_ubl": ("/Invoice/DueDate", "//PaymentMeans/PaymentDueDate"),
}
COUNTS = {"n_lines": ("//IncludedSupplyChainTradeLineItem", "//InvoiceLine", "//CreditNoteLine"), "n_rates": ("//ApplicableHeaderTradeSettlement/ApplicableTradeTax", "//TaxTotal/TaxSubtotal")}
TEXTS = LABELS | AMOUNTS | DATES
#: A step of a path: a name, and in brackets an attribute or a path below that must have a value.
STEP = re.compile(r"(\w+)(?:\[(@?)([\w/]+)='([^']*)'\])?")


def placed(path: str) -> tuple[bool, list[str], list[tuple[int, bool, list[str], str]]]:
    """(from the root, names, conditions) of a path; a condition says how far above the last step its element is."""
    steps = list(STEP.finditer(path))
    return not path.startswith("//"), [m[1] for m in steps], [(len(steps) - 1 - i, m[2] == "@", m[3].split("/"), m[4]) for i, m in enumerate(steps) if m[3]]


#: (name, which of its paths, and where that is) of all that is read.
PLACES = [(n, k, *placed(p)) for n, ps in (TEXTS | COUNTS).items() for k, p in enumerate(ps)]


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def below(e: ET.Element, names: list[str]) -> list[ET.Element]:
    for n in names:
        e = [c for x in (e if isinstance(e, list) else [e]) for c in x if local(c.tag) == n]
    return e


def holds(e: ET.Element, attribute: bool, names: list[str], value: str) -> bool:
    return e.get(names[0]) == value if attribute else any("".join(x.itertext()) == value for x in below(e, names))


class Place:
    """What stands at a path, and the places below it as documents show them."""

    __slots__ = ("names", "here", "below")

    def __init__(self, names: tuple[str, ...]) -> None:
        self.names, self.below = names, {}
        self.here = [(name, k, tests) for name, k, rooted, steps, tests in PLACES if names and names[-len(steps):] == tuple(steps) and (not rooted or len(names) == len(steps))]

    def at(self, tag: str) -> Place:
        found = self.below.get(tag)
        if found is None:
            found = self.below[tag] = Place((*self.names, local(tag)))
        return found


def read_einvoice(xml: str, known: Place) -> dict[str, str | int]:
    """All labels of a document in one walk over its elements. ``known``, the place above all roots, keeps what stands where, for documents alike."""
    first: dict[tuple[str, int], str] = {}
    n = dict.fromkeys(COUNTS, 0)
    root = ET.fromstring(xml.encode())
    todo = [(root, known.at(root.tag), None)]
    while todo:
        e, place, above = todo.pop()
        line = (e, above)
        for name, k, tests in place.here:
            if name in n:
                n[name] += 1
            elif (name, k) not in first and all(holds(ancestor(line, up), *test) for up, *test in tests):
                first[name, k] = "".join(e.itertext()).strip(" ")
        # Leaves where no label stands are not visited: most elements are such.
        below = place.below
        for c in reversed(e):
            at = below.get(c.tag) or place.at(c.tag)
            if at.here or len(c):
                todo.append((c, at, line))
    out = {name: next((t for k in range(len(ps)) if (t := first.get((name, k)))), None) for name, ps in TEXTS.items()}
    return out | n


def ancestor(line: tuple, up: int) -> ET.Element:
    """The element ``up`` levels above the first of a chain (element, chain above it)."""
    for _ in range(up):
        line = line[1]
    return line[0]


READ = T.StructType([*[T.StructField(n, T.StringType()) for n in TEXTS], *[T.StructField(n, T.IntegerType()) for n in COUNTS]])


def einvoice_labels(xml: Column) -> dict[str, Column]:
    """Labels of an e-invoice in either syntax; null where it has none, counts too where there is no document. A document is parsed once for all labels."""

    @F.pandas_udf(READ)
    def labels(texts: pd.Series) -> pd.DataFrame:
        known = Place(())
        none = dict.fromkeys(READ.fieldNames())
        rows = pd.DataFrame([none if x is None else read_einvoice(x, known) for x in texts], columns=READ.fieldNames())
        return rows.astype({n: "Int32" for n in COUNTS})

    read = labels(xml)
    day = lambda n: F.coalesce(F.try_to_date(read[f"{n}_cii"], "yyyyMMdd"), F.try_to_date(read[f"{n}_ubl"], "yyyy-MM-dd"))
    return {
        **{n: read[n] for n in LABELS}, **{n: read[n].try_cast("decimal(18,2)") for n in AMOUNTS}, "issue_date": day("issue"), "due_date": day("due"), **{n: read[n] for n in COUNTS},
    }


def einvoice_fields(xml: Column) -> dict[str, Column]:
    """The labels that documents are graded by."""
    found = einvoice_labels(xml)
    return {n: found[n] for n in ("number", "issue_date", "currency", "seller", "buyer", "total", "tax")}


def einvoice_profile(xml: Column) -> Column:
    """'ubl' or 'cii' by the root, with the guideline or customization id after a space."""
    root = F.regexp_extract(xml, r"<(?:[\w.-]+:)?(Invoice|CreditNote|CrossIndustryInvoice)\b", 1)
    guide = F.regexp_extract(xml, r"<(?:[\w.-]+:)?(?:CustomizationID|GuidelineSpecifiedDocumentContextParameter>\s*<(?:[\w.-]+:)?ID)>\s*([^<\s]+)", 1)
    return F.concat_ws(" ", F.when(root == "CrossIndustryInvoice", "cii").when(root != "", "ubl"), F.nullif(guide, F.lit("")))
