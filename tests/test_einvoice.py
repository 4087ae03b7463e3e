"""E-invoices in both syntaxes, quotes on pages and chains of backends, on small cases."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from concordat.operators import backends, einvoice, export, quotes, schema_gate as G
from concordat.sources import readers

FULL = {
    "invoice_number": 'A&B <1> "x"', "issue_date": "2024-05-06", "due_date": "2024-06-05", "currency": "eur", "subtotal": 30, "tax_rate_percent": 10, "tax_amount": 3.5, "discount_amount": 5, "shipping_amount": 10, "total_amount": 38.5,
    "buyer_reference": "04011000-1", "payment_reference": "RF18", "payment_terms": "30 days", "payment_account": {"iban": "DE89 3704 0044 0532 0130 00", "bic": "COBA DEFF"},
    "references": [{"kind": "purchase_order", "number": "PO7"}, {"kind": "invoice", "number": "I0"}],
    "seller": {"name": "S & Co", "address": {"street": "Weg 1", "city": "Kiel", "postal_code": "24103", "country_code": "de", "region": "SH"}, "tax_ids": [{"value": "DE 136.695-976", "scheme": "vat"}, {"value": "20/123", "scheme": "tax_id"}, {"value": "HRB 1", "scheme": "company_registration"}],
               "contact_name": "Ann", "phone": "1", "email": "a@b", "electronic_address": "a@b"},
    "buyer": {"name": "B", "address": {"text": "Somewhere 5"}}, "line_items": [{"description": "bolt", "quantity": 2.5, "unit_price": 8, "total": 20, "unit_of_measure": "kg", "sku": "S1"}, {"description": "nut", "quantity": 0, "unit_price": 1, "total": 10}],
}


def modelled(spark, *docs, tree="invoice"):
    rows = [(k, json.dumps(d)) for k, d in enumerate(docs)]
    g = G.gate(spark.createDataFrame(rows, "k int, document string"), G.TREES[tree])
    return einvoice.semantic(g, credit_note=tree == "credit_note").select("k", "terms", "refusal").coalesce(1).cache()


def rendered(spark, profile, *docs, tree="invoice"):
    return einvoice.render(modelled(spark, *docs, tree=tree), profile, credit_note=tree == "credit_note").orderBy("k").collect()


def tags(xml):
    return [e.tag.partition("}")[2] for e in ET.fromstring(xml.encode()).iter()]


def test_every_profile_is_well_formed_and_reads_back(spark):
    m = modelled(spark, FULL)
    for profile, p in einvoice.PROFILES.items():
        row = einvoice.render(m, profile).first()
        assert row.refusal is None and ET.fromstring(row.xml.encode()) is not None
        d = spark.createDataFrame([(row.xml,)], "xml string")
        got = d.select(readers.einvoice_profile(F.col("xml")).alias("profile"), *[c.alias(n) for n, c in readers.einvoice_labels(F.col("xml")).items()]).first().asDict()
        assert {k: str(v) for k, v in got.items()} == {
            "profile": f"{p.syntax} {p.guideline}", "number": 'A&B <1> "x"', "currency": "EUR", "seller": "S & Co", "buyer": "B", "seller_vat": "DE136695976", "order_reference": "PO7", "iban": "DE89370400440532013000", "line_total": "30.00", "tax": "3.50",
            "total": "38.50", "issue_date": "2024-05-06", "due_date": "2024-06-05", "n_lines": "2", "n_rates": "1",
        }
        assert ("DefinedTradeContact" in row.xml) == (p.syntax == "cii" and not p.basic) and ("BICID" in row.xml) == (p.syntax == "cii" and not p.basic)


def test_order_and_parts_of_ubl(spark):
    found = tags(rendered(spark, "peppol", FULL)[0].xml)
    top = ["CustomizationID", "ProfileID", "ID", "IssueDate", "DueDate", "InvoiceTypeCode", "DocumentCurrencyCode", "BuyerReference", "OrderReference", "BillingReference", "AccountingSupplierParty", "AccountingCustomerParty", "PaymentMeans", "PaymentTerms", "AllowanceCharge", "TaxTotal", "LegalMonetaryTotal", "InvoiceLine"]
    places = [found.index(t) for t in top]
    assert places == sorted(places) and found.count("AllowanceCharge") == 2 and found.count("PartyTaxScheme") == 2 and found.count("PostalAddress") == 2
    bare = {k: v for k, v in FULL.items() if k in ("invoice_number", "issue_date", "subtotal", "tax_amount", "total_amount", "tax_rate_percent", "line_items")} | {"seller": {"name": "S"}, "buyer": {"name": "B"}, "tax_amount": 3}
    found = tags(rendered(spark, "en16931", bare)[0].xml)
    assert not {"PostalAddress", "Contact", "PartyTaxScheme", "PayeeFinancialAccount", "PaymentTerms", "OrderReference", "DueDate", "ProfileID", "EndpointID"} & set(found)


def test_credit_notes(spark):
    note = {**{k: v for k, v in FULL.items() if k != "invoice_number"}, "credit_note_number": "C1", "reason": "returned", "subtotal": -30, "tax_amount": -3.5, "total_amount": -38.5}
    xml = rendered(spark, "en16931", note, tree="credit_note")[0].xml
    found = tags(xml)
    assert found[0] == "CreditNote" and "CreditNoteLine" in found and "CreditedQuantity" in found and "DueDate" not in found and "PaymentDueDate" in found and ">381<" in xml and ">returned<" in xml


def test_refusals(spark):
    change = lambda **k: {**FULL, **k}
    line = {"description": "x", "unit_price": 10, "total": 10}
    two = [{**line, "tax_rate_percent": 10}, {**line, "total": 20, "tax_rate_percent": 20}]
    rows = rendered(
        spark, "en16931", FULL, change(line_items=[]), change(tax_rate_percent=None, discount_amount=40), change(line_items=two), change(line_items=two, discount_amount=0, shipping_amount=0, tax_amount=5),
        change(line_items=two, discount_amount=0, shipping_amount=0, tax_amount=5.01), change(tax_amount=3.52), change(tax_amount=3.51), change(subtotal=30.02), {"invoice_number": "1"}, change(tax_rate_percent=None),
    )
    assert [r.refusal for r in rows] == [None, "BR-16", "BR-S-05", "mixed rates", None, "tax", "tax", None, "BR-CO-10", "no document", None]
    assert all((r.xml is None) == (r.refusal is not None) for r in rows)
    with pytest.raises(ValueError):
        rendered(spark, "nothing", FULL)


def by_all_windows(quote, page):
    """Least edit distance of the quote to any run of the page, by plain dynamic programming."""
    row = [0] * (len(page) + 1)
    for i, q in enumerate(quote, 1):
        new = [i]
        for j, c in enumerate(page, 1):
            new.append(min(row[j - 1] + (q != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_nearest_place_by_dynamic_programming():
    r = random.Random(5)
    found = 0
    for _ in range(400):
        page = "".join(r.choice("abcd") for _ in range(r.randrange(5, 90)))
        n = r.randrange(3, 80)
        at = r.randrange(0, len(page))
        quote = list(page[at : at + n])
        for _ in range(r.randrange(0, 5)):
            if quote:
                k = r.randrange(len(quote))
                quote[k : k + 1] = r.choice(([], ["x"], [quote[k], "y"]))
        quote = "".join(quote)
        if len(quote) < 3:
            continue
        room, best, got = int(0.2 * len(quote) + 1e-9), by_all_windows(quote, page), quotes.nearest(quote, page)
        assert (got is not None) == (room > 0 and best <= room)
        if got:
            found += 1
            assert distance(quote, page[got[0] : got[1]]) == best and abs(got[2] - (1 - best / len(quote))) < 1e-9
    assert found > 100


def test_backends(spark):
    r = backends.Registry()
    for n, why in (("a", "no program"), ("b", None), ("c", None)):
        r.add(backends.Backend(n, lambda pages, n=n: pages.select("page", F.lit(n * 30).alias("text"), F.lit(0.5).alias("confidence")), lambda why=why: why))
    assert [b.name for b in r.chain("")] == ["b"] and [b.name for b in r.chain(" C, auto,b ")] == ["c", "b"] and r.status()[0] == ("a", "no program")
    for wrong in ("a", "x", "b,a"):
        with pytest.raises(backends.BackendError):
            r.chain(wrong)
    with pytest.raises(backends.BackendError):
        backends.Registry().chain("auto")
    for name in ("b", "", "auto", "Upper"):
        with pytest.raises(backends.BackendError):
            r.add(backends.Backend(name, lambda p: p))
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,)], "page int")
    kept = spark.createDataFrame([(1, "x" * 20, 0.9), (2, "short", 0.9), (3, None, 0.8)], "page int, text string, confidence double")
    weak = spark.createDataFrame([(2, "weak", 0.1), (3, "y" * 25, 0.2)], "page int, text string, confidence double")
    got = backends.read_pages(pages, [backends.recorded("kept", kept), backends.recorded("weak", weak)]).orderBy("page").collect()
    assert [(x.page, x.backend, x.attempts) for x in got] == [(1, "kept", 1), (2, "kept", 2), (3, "weak", 2), (4, None, 2)]
    assert [(x.backend, x.attempts) for x in backends.read_pages(pages, []).collect()] == [(None, 0)] * 4


def test_exporters(spark):
    d = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "needs_review")], "doc_id int, status string")
    e = export.Exporters()
    e.add("ids", lambda rows: rows.select("doc_id"))
    good, refused = e.run(d, "ids")
    assert [r.doc_id for r in good.collect()] == [1] and sorted(r.doc_id for r in refused.collect()) == [2, 3] and e.names() == ["ids"]
    with pytest.raises(ValueError):
        e.add("ids", lambda rows: rows)
    with pytest.raises(ValueError):
        e.run(d, "nothing")


def test_invoices_of_a_small_table_are_many_tasks(spark):
    from concordat.plans import einvoices

    assert einvoices.invoices(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_documents_are_parsed_once_and_written_once(spark):
    from concordat.plans import einvoices

    for profile in ("peppol", "factur-x-en16931"):
        plan = einvoices.round_trip(spark, "/root/testdata/sf0.001", profile)._jdf.queryExecution().optimizedPlan().toString()
        assert "xpath" not in plan.lower() and plan.count("ArrowEvalPython") == 1
    row = spark.range(1).select(einvoice.el("a", einvoice.el("b", F.lit("")), einvoice.el("c", einvoice.el("d", F.lit(None).cast("string")))).text.alias("none"), einvoice.el("a", einvoice.el("b", ""), einvoice.el("c", "x", k="")).text.alias("some")).first()
    assert row.none is None and row.some == '<a><c k="">x</c></a>'


def test_labels_stand_where_paths_say(spark):
    supplier = "<AccountingSupplierParty><Party><PartyTaxScheme><CompanyID>A</CompanyID><TaxScheme><ID>FC</ID></TaxScheme></PartyTaxScheme><PartyTaxScheme><CompanyID>B</CompanyID><TaxScheme><ID>VAT</ID></TaxScheme></PartyTaxScheme><PartyName><Name/></PartyName><PartyLegalEntity><RegistrationName>R</RegistrationName></PartyLegalEntity></Party></AccountingSupplierParty>"
    xml = f"<Invoice xmlns='u'><X><Invoice><ID>no</ID></Invoice></X>{supplier}<ID> 7 </ID><ID>8</ID><InvoiceLine/><InvoiceLine/></Invoice>"
    d = spark.createDataFrame([(0, xml), (1, None)], "k int, xml string")
    got, none = d.select("k", *[c.alias(n) for n, c in readers.einvoice_labels(F.col("xml")).items()]).orderBy("k").collect()
    assert (got.number, got.seller, got.seller_vat, got.n_lines, got.n_rates, got.total) == ("7", "R", "B", 2, 0, None) and set(none[1:]) == {None}
