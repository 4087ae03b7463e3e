"""Invoices and credit notes as EN 16931: the semantic model of a typed document, and its two syntaxes.

Both are expressions of the JVM over one row, the document as the schema gate types it: sums,
groups of rates and refusals by array functions, XML by nesting text. An element without
content is null and so is not written, so optional terms need no rule of their own. What the
document does not state is not written; what it states otherwise than the model can express is
a refusal with the rule's id.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions import checks, money
from concordat.operators import export

CENTS, RATE = "decimal(18,2)", "decimal(8,2)"


class Profile(NamedTuple):
    syntax: str
    guideline: str
    process: str | None = None
    basic: bool = False


PROFILES = {name: Profile(syntax, guideline, process, basic=name == "factur-x-basic") for name, syntax, guideline, process in export.PROFILES}


def cents(c: Column) -> Column:
    return money.cents(c.cast("decimal(28,6)")).cast(CENTS)


def semantic(docs: DataFrame, value: str = "value", *, credit_note: bool = False) -> DataFrame:
    """``docs`` with ``terms``, the struct of business terms, null where ``refusal`` says why there is none.

    ``value`` is an invoice or credit note of the schema gate. Refusals: no lines (BR-16), a line without a rate (BR-S-05), a
    document discount or charge over several rates, a tax that the rates do not give, lines that are not the subtotal (BR-CO-10).
    """
    v = F.col(value)
    zero = F.lit(0).cast(CENTS)
    allowance, charge, tax, sub = (F.coalesce(cents(v[c]), zero) for c in ("discount_amount", "shipping_amount", "tax_amount", "subtotal"))
    x = docs.withColumn("__rate", export.implied_rate(v["tax_rate_percent"], v["subtotal"], v["discount_amount"], v["shipping_amount"], v["tax_amount"]))

    def line(l: Column, i: Column) -> Column:  # noqa: E741
        counted = F.coalesce(l["quantity"] != 0, F.lit(False))
        rate = F.coalesce(l["tax_rate_percent"].cast(RATE), F.col("__rate"))
        return F.struct(
            (i + 1).cast("string").alias("id"), l["description"].alias("name"), F.when(counted, l["quantity"]).otherwise(F.lit(1).cast("decimal(28,6)")).alias("quantity"), export.unit_code(l["unit_of_measure"]).alias("unit"),
            F.when(counted, cents(l["unit_price"])).otherwise(cents(l["total"])).alias("price"), cents(l["total"]).alias("net"), F.when(rate > 0, "S").otherwise("Z").alias("category"), rate.alias("rate"), l["sku"].alias("item_id"),
        )

    x = x.withColumn("__lines", F.transform(v["line_items"], line))
    lines = F.col("__lines")
    kinds = F.array_distinct(F.transform(lines, lambda l: F.struct(l["category"].alias("category"), l["rate"].alias("rate"))))
    total = lambda rows: F.aggregate(rows, zero, lambda a, n: (a + n).cast(CENTS))
    x = x.withColumn("__kinds", kinds).withColumn("__sum", total(F.transform(lines, lambda l: l["net"])))
    one = F.size("__kinds") == 1

    def group(k: Column) -> Column:
        net = total(F.transform(F.filter(lines, lambda l: l["rate"].eqNullSafe(k["rate"])), lambda l: l["net"]))
        taxable = (net + F.when(one, charge - allowance).otherwise(zero)).cast(CENTS)
        return F.struct(k["category"].alias("category"), k["rate"].alias("rate"), taxable.alias("taxable"), cents(taxable * k["rate"] / 100).alias("tax"))

    x = x.withColumn("__groups", F.transform("__kinds", group)).withColumn("__tax", total(F.transform("__groups", lambda g: g["tax"])))
    cent = F.lit("0.01").cast(CENTS)
    refusal = (
        F.when(v.isNull(), "no document").when(F.size(lines) == 0, "BR-16").when(F.exists(lines, lambda l: l["rate"].isNull()), "BR-S-05")
        .when(~one & ((allowance != 0) | (charge != 0)), "mixed rates").when(one & (F.abs(F.col("__tax") - tax) > cent), "tax").when(~one & (F.col("__tax") != tax), "tax")
        .when(F.abs(F.col("__sum") - sub) > cent, "BR-CO-10")
    )
    said = lambda c: F.regexp_replace(c, " ", "")
    account = v["payment_account"]
    of_kind = lambda kind: F.get(F.filter(v["references"], lambda r: r["kind"] == kind), F.lit(0))["number"]
    exclusive = (F.col("__sum") - allowance + charge).cast(CENTS)
    iban, number = F.nullif(said(account["iban"]), F.lit("")), F.nullif(said(account["account_number"]), F.lit(""))
    terms = F.struct(
        v["credit_note_number" if credit_note else "invoice_number"].alias("number"), v["issue_date"].alias("issue_date"), v["due_date"].alias("due_date"), F.lit("381" if credit_note else "380").alias("type_code"),
        F.upper(v["currency"]).alias("currency"), v["buyer_reference"].alias("buyer_reference"), of_kind("purchase_order").alias("order_reference"), of_kind("invoice").alias("preceding_invoice"),
        party(v["seller"]).alias("seller"), party(v["buyer"]).alias("buyer"), v["payment_reference"].alias("payment_reference"), v["payment_terms"].alias("payment_terms"), iban.alias("iban"), F.nullif(said(account["bic"]), F.lit("")).alias("bic"),
        number.alias("account_number"), F.when(iban.isNotNull(), "58").when(number.isNotNull(), "30").otherwise("1").alias("payment_means"), (v["reason"] if credit_note else F.lit(None).cast("string")).alias("note"), lines.alias("lines"),
        allowance.alias("allowance"), charge.alias("charge"),
        # Of one rate the stated tax is the breakdown's: a cent is the document's own rounding.
        F.when(one, F.transform("__groups", lambda g: F.struct(g["category"].alias("category"), g["rate"].alias("rate"), g["taxable"].alias("taxable"), tax.alias("tax")))).otherwise(F.col("__groups")).alias("groups"),
        F.col("__sum").alias("line_total"), exclusive.alias("tax_exclusive"), tax.alias("tax_total"), (exclusive + tax).cast(CENTS).alias("tax_inclusive"), (exclusive + tax).cast(CENTS).alias("payable"),
    )
    x = x.withColumn("refusal", refusal)
    return x.withColumn("terms", F.when(F.col("refusal").isNull(), terms)).drop("__rate", "__lines", "__kinds", "__sum", "__groups", "__tax")


def party(p: Column) -> Column:
    """Names, addresses and the three kinds of identifiers of a party."""
    ids = p["tax_ids"]
    first = lambda rows: F.get(rows, F.lit(0))["value"]
    vat = F.coalesce(first(F.filter(ids, lambda t: t["scheme"] == "vat")), first(F.filter(ids, lambda t: F.coalesce(checks.vat_format(t["value"]), F.lit(False)))))
    return F.struct(
        p["name"].alias("name"), p["address"].alias("address"), F.upper(F.regexp_replace(vat, r"[\s.\-/]", "")).alias("vat_id"),
        first(F.filter(ids, lambda t: t["scheme"].isin("tax_id", "gst") & ~t["value"].eqNullSafe(vat))).alias("tax_registration"), first(F.filter(ids, lambda t: t["scheme"] == "company_registration")).alias("legal_id"),
        p["contact_name"].alias("contact"), p["phone"].alias("phone"), p["email"].alias("email"), p["electronic_address"].alias("endpoint"), F.coalesce(p["electronic_address_scheme"], F.lit("EM")).alias("endpoint_scheme"),
    )


# XML as nested text.
def escaped(c: Column) -> Column:
    s = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


class Xml(NamedTuple):
    """A part of a document: text of markup, null or empty where there is nothing to write. ``sure``: there always is."""

    text: Column
    sure: bool = False


class Plain(NamedTuple):
    """A value whose text has no sign of markup: a number, a date, a code."""

    value: Column


def content(text: Column) -> Column:
    """Null for an empty text. The text stands in the expression once, as elements nest deep, and in no lambda, as Spark compiles what none holds."""
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def written(value: object) -> Column:
    """The text of a column, a literal or a ``Plain``."""
    return value.value.cast("string") if isinstance(value, Plain) else escaped(value if isinstance(value, Column) else F.lit(value))


def el(name: str, *inside: object, **attributes: object) -> Xml:
    """An element around a value (column or literal) or other parts, null where it would be empty. Each part stands in the expression once."""
    if inside and all(isinstance(p, Xml) for p in inside):
        sure, body = any(p.sure for p in inside), F.concat_ws("", *[p.text for p in inside])
    else:
        sure, body = isinstance(inside[0], str) and inside[0] != "", written(inside[0])
    body = body if sure else content(body)
    tag = [F.lit(f"<{name}")]
    for a, value in attributes.items():
        tag += [F.lit(f' {a}="'), F.coalesce(written(value), F.lit("")), F.lit('"')]
    return Xml(F.concat(*tag, F.lit(">"), body, F.lit(f"</{name}>")), sure)


def each(rows: Column, part: Callable[[Column], Xml]) -> Xml:
    return Xml(F.array_join(F.transform(rows, lambda r: part(r).text), ""))


def only(when: Column, part: Xml) -> Xml:
    return Xml(F.when(when, part.text))


def plain(q: Column) -> Column:
    """A quantity without zeros at its end."""
    s = q.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


UBL = {
    "": "urn:oasis:names:specification:ubl:schema:xsd:{root}-2", "cac": "urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2", "cbc": "urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2",
}
CII = {
    "rsm": "urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100", "ram": "urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100", "udt": "urn:un:unece:uncefact:data:standard:UnqualifiedDataType:100",
}


def document(root: str, spaces: dict[str, str], *parts: Xml) -> Column:
    names = "".join(f' xmlns{":" + p if p else ""}="{uri.format(root=root.split(":")[-1])}"' for p, uri in spaces.items())
    return F.concat_ws("", F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}{names}>'), *[p.text for p in parts], F.lit(f"</{root}>"))


def ubl(t: Column, profile: Profile, currency: Plain, *, credit_note: bool = False) -> Column:
    """The terms in the order of the UBL schema. ``currency``: that of the terms as it is written."""
    a, b = (lambda n, *x: el(f"cac:{n}", *x)), (lambda n, x, **at: el(f"cbc:{n}", x, **at))
    money_ = lambda n, x: b(n, Plain(x), currencyID=currency)
    scheme = lambda s: a("TaxScheme", b("ID", s))
    category = lambda n, g: a(n, b("ID", Plain(g["category"])), b("Percent", Plain(g["rate"])), scheme("VAT"))

    def side(role: str, p: Column, seller: bool) -> Xml:
        d = p["address"]
        identified = lambda value, kind: only(value.isNotNull(), a("PartyTaxScheme", b("CompanyID", value), scheme(kind)))
        return a(role, a(
            "Party", b("EndpointID", p["endpoint"], schemeID=p["endpoint_scheme"]), a("PartyName", b("Name", p["name"])),
            a("PostalAddress", b("StreetName", F.coalesce(F.nullif(d["street"], F.lit("")), d["text"])), b("AdditionalStreetName", d["additional_line"]), b("CityName", d["city"]), b("PostalZone", d["postal_code"]),
              b("CountrySubentity", d["region"]), a("Country", b("IdentificationCode", d["country_code"]))),
            identified(p["vat_id"], "VAT"), *([identified(p["tax_registration"], "FC")] if seller else []), a("PartyLegalEntity", b("RegistrationName", p["name"]), b("CompanyID", p["legal_id"])),
            a("Contact", b("Name", p["contact"]), b("Telephone", p["phone"]), b("ElectronicMail", p["email"])),
        ))

    first = F.get(t["groups"], F.lit(0))
    extra = lambda amount, flag, why: only(amount != 0, a("AllowanceCharge", b("ChargeIndicator", flag), b("AllowanceChargeReason", why), money_("Amount", amount), category("TaxCategory", first)))
    kind = "CreditNote" if credit_note else "Invoice"
    line = lambda l: a(
        f"{kind}Line", b("ID", Plain(l["id"])), b("CreditedQuantity" if credit_note else "InvoicedQuantity", Plain(plain(l["quantity"])), unitCode=Plain(l["unit"])), money_("LineExtensionAmount", l["net"]),
        a("Item", b("Name", l["name"]), a("SellersItemIdentification", b("ID", l["item_id"])), category("ClassifiedTaxCategory", l)), a("Price", money_("PriceAmount", l["price"])),
    )
    due = b("DueDate", t["due_date"])
    return document(
        kind, UBL, b("CustomizationID", profile.guideline), *([b("ProfileID", profile.process)] if profile.process else []), b("ID", t["number"]), b("IssueDate", t["issue_date"]), *([] if credit_note else [due]),
        b(f"{kind}TypeCode", t["type_code"]), b("Note", t["note"]), b("DocumentCurrencyCode", t["currency"]), b("BuyerReference", t["buyer_reference"]), a("OrderReference", b("ID", t["order_reference"])),
        a("BillingReference", a("InvoiceDocumentReference", b("ID", t["preceding_invoice"]))), side("AccountingSupplierParty", t["seller"], True), side("AccountingCustomerParty", t["buyer"], False),
        a("PaymentMeans", b("PaymentMeansCode", t["payment_means"]), *([b("PaymentDueDate", t["due_date"])] if credit_note else []), b("PaymentID", t["payment_reference"]),
          a("PayeeFinancialAccount", b("ID", F.coalesce(t["iban"], t["account_number"])), only(t["iban"].isNotNull() | t["account_number"].isNotNull(), a("FinancialInstitutionBranch", b("ID", t["bic"]))))),
        a("PaymentTerms", b("Note", t["payment_terms"])), extra(t["allowance"], "false", "Discount"), extra(t["charge"], "true", "Shipping"),
        a("TaxTotal", money_("TaxAmount", t["tax_total"]), each(t["groups"], lambda g: a("TaxSubtotal", money_("TaxableAmount", g["taxable"]), money_("TaxAmount", g["tax"]), category("TaxCategory", g)))),
        a("LegalMonetaryTotal", money_("LineExtensionAmount", t["line_total"]), money_("TaxExclusiveAmount", t["tax_exclusive"]), money_("TaxInclusiveAmount", t["tax_inclusive"]),
          only(t["allowance"] != 0, money_("AllowanceTotalAmount", t["allowance"])), only(t["charge"] != 0, money_("ChargeTotalAmount", t["charge"])), money_("PayableAmount", t["payable"])),
        each(t["lines"], line),
    )


def cii(t: Column, profile: Profile, currency: Plain) -> Column:
    """The terms in the order of the cross-industry schema, with the currency as it is written; the basic profile has no item ids, contacts and BIC."""
    r = lambda n, *x, **at: el(f"ram:{n}", *x, **at)
    day = lambda n, d: only(d.isNotNull(), r(n, el("udt:DateTimeString", F.date_format(d, "yyyyMMdd"), format="102")))
    full = lambda *x: [] if profile.basic else list(x)

    def tax(n: str, g: Column, *, amounts: bool = False) -> Xml:
        before, basis = ([r("CalculatedAmount", Plain(g["tax"]))], [r("BasisAmount", Plain(g["taxable"]))]) if amounts else ([], [])
        return r(n, *before, r("TypeCode", "VAT"), *basis, r("CategoryCode", Plain(g["category"])), r("RateApplicablePercent", Plain(g["rate"])))

    def side(role: str, p: Column, seller: bool) -> Xml:
        d = p["address"]
        contact = full(r("DefinedTradeContact", r("PersonName", p["contact"]), r("TelephoneUniversalCommunication", r("CompleteNumber", p["phone"])), r("EmailURIUniversalCommunication", r("URIID", p["email"])))) if seller else []
        registered = lambda value, kind: r("SpecifiedTaxRegistration", r("ID", value, schemeID=kind))
        no_city = F.coalesce(d["city"], F.lit("")) == ""
        return r(
            role, r("Name", p["name"]), r("SpecifiedLegalOrganization", r("ID", p["legal_id"])), *contact,
            r("PostalTradeAddress", r("PostcodeCode", d["postal_code"]), r("LineOne", F.coalesce(F.nullif(d["street"], F.lit("")), F.when(no_city, d["text"]))), r("LineTwo", d["additional_line"]), r("CityName", d["city"]),
              r("CountryID", d["country_code"]), only(F.coalesce(d["country_code"], F.lit("")) != "", r("CountrySubDivisionName", d["region"]))),
            r("URIUniversalCommunication", r("URIID", p["endpoint"], schemeID=p["endpoint_scheme"])), registered(p["vat_id"], "VA"), *([registered(p["tax_registration"], "FC")] if seller else []),
        )

    line = lambda l: r(
        "IncludedSupplyChainTradeLineItem", r("AssociatedDocumentLineDocument", r("LineID", Plain(l["id"]))), r("SpecifiedTradeProduct", *full(r("SellerAssignedID", l["item_id"])), r("Name", l["name"])),
        r("SpecifiedLineTradeAgreement", r("NetPriceProductTradePrice", r("ChargeAmount", Plain(l["price"])))), r("SpecifiedLineTradeDelivery", r("BilledQuantity", Plain(plain(l["quantity"])), unitCode=Plain(l["unit"]))),
        r("SpecifiedLineTradeSettlement", tax("ApplicableTradeTax", l), r("SpecifiedTradeSettlementLineMonetarySummation", r("LineTotalAmount", Plain(l["net"])))),
    )
    first = F.get(t["groups"], F.lit(0))
    extra = lambda amount, flag, why: only(amount != 0, r("SpecifiedTradeAllowanceCharge", r("ChargeIndicator", el("udt:Indicator", flag)), r("ActualAmount", amount), r("Reason", why), tax("CategoryTradeTax", first)))
    owned = r("PayeePartyCreditorFinancialAccount", r("IBANID", t["iban"]), only(t["iban"].isNull(), r("ProprietaryID", t["account_number"])))
    bank = full(only(t["iban"].isNotNull(), r("PayeeSpecifiedCreditorFinancialInstitution", r("BICID", t["bic"]))))
    return document(
        "rsm:CrossIndustryInvoice", CII,
        el("rsm:ExchangedDocumentContext", *([r("BusinessProcessSpecifiedDocumentContextParameter", r("ID", profile.process))] if profile.process else []), r("GuidelineSpecifiedDocumentContextParameter", r("ID", profile.guideline))),
        el("rsm:ExchangedDocument", r("ID", t["number"]), r("TypeCode", t["type_code"]), day("IssueDateTime", t["issue_date"]), r("IncludedNote", r("Content", t["note"]))),
        el(
            "rsm:SupplyChainTradeTransaction", each(t["lines"], line),
            r("ApplicableHeaderTradeAgreement", r("BuyerReference", t["buyer_reference"]), side("SellerTradeParty", t["seller"], True), side("BuyerTradeParty", t["buyer"], False), r("BuyerOrderReferencedDocument", r("IssuerAssignedID", t["order_reference"]))),
            Xml(F.lit("<ram:ApplicableHeaderTradeDelivery/>"), True),
            r(
                "ApplicableHeaderTradeSettlement", r("PaymentReference", t["payment_reference"]), r("InvoiceCurrencyCode", t["currency"]), r("SpecifiedTradeSettlementPaymentMeans", r("TypeCode", t["payment_means"]), owned, *bank),
                each(t["groups"], lambda g: tax("ApplicableTradeTax", g, amounts=True)), extra(t["allowance"], "false", "Discount"), extra(t["charge"], "true", "Shipping"),
                r("SpecifiedTradePaymentTerms", r("Description", t["payment_terms"]), day("DueDateDateTime", t["due_date"])),
                r("SpecifiedTradeSettlementHeaderMonetarySummation", r("LineTotalAmount", t["line_total"]), only(t["charge"] != 0, r("ChargeTotalAmount", t["charge"])), only(t["allowance"] != 0, r("AllowanceTotalAmount", t["allowance"])),
                  r("TaxBasisTotalAmount", t["tax_exclusive"]), r("TaxTotalAmount", Plain(t["tax_total"]), currencyID=currency), r("GrandTotalAmount", t["tax_inclusive"]), r("DuePayableAmount", t["payable"])),
                r("InvoiceReferencedDocument", r("IssuerAssignedID", t["preceding_invoice"])),
            ),
        ),
    )


def render(docs: DataFrame, profile: str, *, credit_note: bool = False) -> DataFrame:
    """``docs`` (with the terms of ``semantic``) with ``xml``, null for what was refused. ValueError for a profile that nobody knows."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; there are {', '.join(PROFILES)}")
    p, t = PROFILES[profile], F.col("terms")
    currency = Plain(F.col("__currency"))  # each amount of a line names it: written once a document
    text = ubl(t, p, currency, credit_note=credit_note) if p.syntax == "ubl" else cii(t, p, currency)
    return docs.withColumn("__currency", escaped(t["currency"])).withColumn("xml", F.when(t.isNotNull(), text)).drop("__currency")
