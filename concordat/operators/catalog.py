"""Schemas of documents: versions, mappings for export, migrations, and where personal data lies."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Schema(NamedTuple):
    schema_id: str
    version: str
    summary: dict[str, str]
    items: str | None
    columns: dict[str, str]
    cited: tuple[str, ...]
    personal: dict[str, str]


PARTY = {"name": "name", "address": "address", "tax_ids": "identifier", "email": "contact", "phone": "contact", "contact_name": "name"}


def party(*roles: str) -> dict[str, str]:
    return {f"{r}.{p}": c for r in roles for p, c in PARTY.items()}


LINES = {c: c for c in ("description", "quantity", "unit_price", "total", "sku", "unit_of_measure", "tax_rate_percent")}
AMOUNTS = {"currency": "currency", "subtotal": "subtotal", "tax": "tax_amount", "total": "total_amount"}
SCHEMAS = (
    Schema("invoice", "2.0", {"number": "invoice_number", "issue_date": "issue_date", "counterparty": "seller.name", **AMOUNTS}, "line_items", LINES, ("invoice_number", "issue_date", "total_amount"), {**party("seller", "buyer"), "payment_account.iban": "account"}),
    Schema("credit_note", "1.0", {"number": "credit_note_number", "issue_date": "issue_date", "counterparty": "seller.name", **AMOUNTS}, "line_items", LINES, ("credit_note_number", "issue_date", "total_amount"), party("seller", "buyer")),
    Schema("receipt", "1.3", {"issue_date": "transaction_date", "counterparty": "merchant_name", **AMOUNTS}, "items", {"description": "description", "quantity": "quantity", "unit_price": "unit_price", "total": "price"}, ("merchant_name", "transaction_date", "total_amount"), {"card_last_four": "account"}),
    Schema("contract", "1.1", {"number": "contract_title", "issue_date": "effective_date", "currency": "currency", "total": "contract_value"}, None, {}, ("parties_a", "parties_b", "effective_date"), {"parties_a": "name", "parties_b": "name", "signatories": "name"}),
    Schema("purchase_order", "2.0", {"number": "po_number", "issue_date": "po_date", "counterparty": "supplier.name", **AMOUNTS}, "line_items", LINES, ("po_number", "po_date", "total_amount"), party("supplier", "buyer")),
    Schema("bank_statement", "1.1", {"issue_date": "statement_period_end", "counterparty": "bank_name", "currency": "currency", "total": "closing_balance"}, "transactions", {"description": "description", "total": "amount"}, ("opening_balance", "closing_balance"), {"account_holder": "name", "account_iban": "account", "transactions.counterparty_name": "name", "transactions.counterparty_iban": "account"}),
    Schema("waybill", "1.1", {"number": "waybill_number", "issue_date": "waybill_date", "counterparty": "shipper_name", "total": "total_amount"}, "items", {"description": "item_name", "quantity": "quantity", "unit_price": "unit_price", "total": "total_price", "sku": "sku"}, ("waybill_number", "waybill_date"), {"shipper_name": "name", "consignee_name": "name", "vehicle_number": "identifier"}),
)


def version_key(version: Column) -> Column:
    """Versions compare as arrays of numbers: 1.10 is after 1.9."""
    return F.transform(F.split(version, r"\."), lambda p: p.cast("int"))


def latest(specs: DataFrame) -> DataFrame:
    """The highest version of each schema_id."""
    return specs.groupBy("schema_id").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))


def personal_paths(spark: SparkSession, schemas: tuple[Schema, ...] = SCHEMAS) -> DataFrame:
    """(schema_id, path, category)."""
    return spark.createDataFrame([(s.schema_id, p, c) for s in schemas for p, c in s.personal.items()], "schema_id string, path string, category string")


def migrate(docs: DataFrame, steps: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]], to: str, version: str = "schema_version") -> DataFrame:
    """Documents brought to version ``to`` along a chain {from: (to, change)}; each step touches the rows of its version only."""
    for old, (new, change) in steps.items():
        moved = change(docs.where(F.col(version) == old)).withColumn(version, F.lit(new))
        docs = docs.where(~(F.col(version) == old) | F.col(version).isNull()).unionByName(moved, allowMissingColumns=True)
        if new == to:
            break
    return docs


def parties_from_flat(docs: DataFrame) -> DataFrame:
    """Flat seller and buyer columns (name, vat) as party structs."""
    def build(role: str) -> Column:
        vat = F.col(f"{role}_vat")
        ids = F.when(vat.isNotNull(), F.array(F.struct(vat.alias("value"), F.lit("vat").alias("scheme"))))
        return F.struct(F.col(f"{role}_name").alias("name"), F.coalesce(ids, F.array().cast("array<struct<value:string,scheme:string>>")).alias("tax_ids"))

    return docs.withColumns({r: build(r) for r in ("seller", "buyer")}).drop("seller_name", "seller_vat", "buyer_name", "buyer_vat")
