"""Each rule alone: a clean document fires nothing, and one planted error fires exactly its rule."""

import datetime as dt
from decimal import Decimal as D

import pytest

from concordat.operators import validation

ITEM = "struct<description:string,quantity:decimal(18,2),unit_price:decimal(18,2),total:decimal(18,2),tax_rate_percent:decimal(6,2),discounts:array<decimal(28,6)>>"
IDS = "array<struct<value:string,scheme:string,country_code:string>>"
SCHEMAS = {
    "invoice": f"doc_id int, number string, issue_date date, due_date date, iban string, bic string, seller string, buyer string, subtotal decimal(18,2), tax_rate_percent decimal(6,2), tax_amount decimal(18,2), shipping_amount decimal(18,2), discount_amount decimal(18,2), total_amount decimal(18,2), page_rates array<decimal(28,6)>, line_items array<{ITEM}>, seller_tax_ids {IDS}, buyer_tax_ids {IDS}",
    "receipt": "doc_id int, subtotal decimal(18,2), tax_amount decimal(18,2), tip_amount decimal(18,2), discount_amount decimal(18,2), total_amount decimal(18,2), amount_tendered decimal(18,2), change_given decimal(18,2), merchant_tax_id string, country_code string, items array<struct<quantity:decimal(18,2),unit_price:decimal(18,2),price:decimal(18,2)>>",
    "contract": "doc_id int, parties_a array<string>, parties_b array<string>, effective_date date, expiration_date date, contract_value decimal(18,2), currency string, notice_period_days int, cure_period_days int, raw_text string",
    "bank_statement": "doc_id int, bank_name string, account_holder string, period_start date, period_end date, iban string, opening_balance decimal(18,2), total_deposits decimal(18,2), total_withdrawals decimal(18,2), closing_balance decimal(18,2), transactions array<struct<amount:decimal(18,2),balance_after:decimal(18,2)>>",
    "waybill": "doc_id int, number string, shipper string, consignee string, waybill_date date, total_quantity decimal(18,2), total_gross_weight_kg decimal(18,2), total_amount decimal(18,2), items array<struct<quantity:decimal(18,2),gross_weight_kg:decimal(18,2),unit_price:decimal(18,2),total_price:decimal(18,2)>>",
}
DAY = dt.date(2024, 5, 6)
line = lambda q, p, t: ("x", D(q), D(p), D(t), None, [])
CLEAN = {
    "invoice": dict(number="7", issue_date=DAY, due_date=DAY, iban="DE89370400440532013000", bic="DEUTDEFF", seller="A GmbH", buyer="B Ltd", subtotal=D("30.00"), tax_rate_percent=D("10"), tax_amount=D("3.00"), shipping_amount=None, discount_amount=None, total_amount=D("33.00"), page_rates=[], line_items=[line("2", "10", "20.00"), line("1", "10", "10.01")], seller_tax_ids=[("DE136695976", "vat", "DE")], buyer_tax_ids=[]),
    "receipt": dict(subtotal=D("10.00"), tax_amount=D("1.00"), tip_amount=None, discount_amount=None, total_amount=D("11.00"), amount_tendered=D("20.00"), change_given=D("9.00"), merchant_tax_id=None, country_code=None, items=[(D("2"), D("5.00"), D("10.00"))]),
    "contract": dict(parties_a=["Acme Corp"], parties_b=["Beta Ltd"], effective_date=DAY, expiration_date=None, contract_value=D("5"), currency="EUR", notice_period_days=30, cure_period_days=30, raw_text="Acme Corp and Beta Ltd as of 6 May 2024"),
    "bank_statement": dict(bank_name="B", account_holder="H", period_start=DAY, period_end=DAY, iban=None, opening_balance=D("100"), total_deposits=D("50"), total_withdrawals=D("20"), closing_balance=D("130"), transactions=[(D("50"), D("150")), (D("-20"), D("130"))]),
    "waybill": dict(number="1", shipper="A", consignee="B", waybill_date=DAY, total_quantity=D("3"), total_gross_weight_kg=None, total_amount=D("30"), items=[(D("3"), None, D("10"), D("30"))]),
}
PLANTED = [
    ("invoice", {"number": " "}, {"number_empty"}), ("invoice", {"due_date": dt.date(2024, 5, 5)}, {"due_before_issue"}), ("invoice", {"issue_date": dt.date(1980, 1, 1)}, {"issue_date_range"}),
    ("invoice", {"iban": "DE89370400440532013001"}, {"iban_checksum"}), ("invoice", {"iban": "[IBAN]"}, {"iban_shape"}), ("invoice", {"iban": "US123"}, {"iban_not_used"}), ("invoice", {"bic": "X"}, {"bic_shape"}),
    ("invoice", {"buyer": "a"}, {"seller_is_buyer"}), ("invoice", {"tax_rate_percent": D("20")}, {"rate_times_subtotal"}), ("invoice", {"line_items": [line("2", "10", "20.00"), line("1", "10", "10.02")]}, {"line_arithmetic", "lines_sum_to_subtotal"}),
    ("invoice", {"total_amount": D("33.02")}, {"total_equation"}), ("invoice", {"total_amount": D("33.01")}, set()), ("invoice", {"seller_tax_ids": [("DE136695977", "vat", "DE")]}, {"seller_tax_ids"}), ("invoice", {"line_items": [line("-3", "10", "-30.00")]}, set()),
    ("invoice", {"line_items": [("x", D("1"), D("40"), D("30.00"), None, [D("25")])]}, set()), ("invoice", {"line_items": []}, set()),
    ("receipt", {"total_amount": D("170.00")}, {"receipt_total", "receipt_tender"}), ("receipt", {"items": [(D("2"), D("5.00"), D("11.00"))]}, set()), ("receipt", {"items": [(D("2"), D("5.00"), D("12.00"))]}, {"receipt_lines", "receipt_items_sum"}),
    ("receipt", {"amount_tendered": D("20.05")}, set()), ("receipt", {"amount_tendered": D("20.06")}, {"receipt_tender"}), ("receipt", {"merchant_tax_id": "503504565", "country_code": "PT"}, {"receipt_tax_id"}),
    ("contract", {"parties_a": [" "]}, {"party_missing", "parties_in_text"}), ("contract", {"parties_b": ["Acme Corporation"], "raw_text": None}, {"same_party"}), ("contract", {"parties_b": ["Acme Holdings Europe"], "raw_text": None}, {"related_party"}), ("contract", {"expiration_date": dt.date(2024, 1, 1), "raw_text": None}, {"expires_before_start"}),
    ("contract", {"currency": None}, {"contract_amounts"}), ("contract", {"cure_period_days": 200}, {"contract_periods"}), ("contract", {"raw_text": "Acme Corp and Beta Ltd"}, {"dates_in_text"}),
    ("bank_statement", {"closing_balance": D("131")}, {"balance_equation"}), ("bank_statement", {"total_deposits": D("51"), "closing_balance": D("131")}, {"movement_sums"}), ("bank_statement", {"transactions": [(D("50"), D("151")), (D("-20"), D("131"))]}, {"running_balance"}), ("bank_statement", {"bank_name": ""}, {"statement_head"}),
    ("waybill", {"total_quantity": D("4")}, {"waybill_sums"}), ("waybill", {"items": [(D("3"), None, D("10"), D("31"))], "total_amount": D("31")}, {"waybill_prices"}), ("waybill", {"shipper": "Ω", "consignee": "Ж"}, {"waybill_names"}),
]


@pytest.mark.parametrize("schema", SCHEMAS)
def test_rules(spark, schema):
    cases = [({}, set())] + [(change, want) for s, change, want in PLANTED if s == schema]
    fields = list(CLEAN[schema])
    rows = [(i, *[(CLEAN[schema] | change)[f] for f in fields]) for i, (change, _) in enumerate(cases)]
    found = {}
    for r in validation.issues(spark.createDataFrame(rows, SCHEMAS[schema]), schema, validation.Context(as_of="2025-01-01")).collect():
        found.setdefault(r.doc_id, set()).add(r.rule)
    for i, (change, want) in enumerate(cases):
        assert found.get(i, set()) == want, change


def test_cited_invoices_of_a_small_table_are_many_tasks(spark):
    from concordat.plans import runs

    assert runs.cited_invoices(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
