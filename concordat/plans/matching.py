"""Queries of the reconciliation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.operators import matching
from concordat.plans import derived
from concordat.session import table

MONEY = "decimal(18,2)"


def po_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrepancies of invoice lines against the order, with 2 % allowed on quantities."""
    m = matching.matched_lines(derived.invoice_lines(spark, sf_dir), derived.order_lines(spark, sf_dir))
    d = matching.line_discrepancies(m, quantity_percent=2.0)
    return d.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("difference").cast(MONEY).alias("difference"))


def po_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoice, order = derived.headers(spark, sf_dir)
    _, status = matching.invoice_to_order(invoice, derived.invoice_lines(spark, sf_dir), order, derived.order_lines(spark, sf_dir))
    return status


def po_header_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoice, order = derived.headers(spark, sf_dir)
    found, _ = matching.invoice_to_order(invoice, derived.invoice_lines(spark, sf_dir), order, derived.order_lines(spark, sf_dir))
    found = found.where("type in ('po_number_mismatch', 'currency_mismatch', 'party_mismatch', 'total_mismatch')")
    return found.select("id", "type", "field", "expected", "actual", "difference", "severity")


def unordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts billed that no order line of the same order names."""
    ordered = derived.order_lines(spark, sf_dir).select("id", matching.key_of(F.col("description")).alias("d")).distinct()
    billed = derived.invoice_lines(spark, sf_dir).withColumn("d", matching.key_of(F.col("description")))
    return billed.join(ordered, ["id", "d"], "left_anti").groupBy("id", "d").agg(F.count(F.lit(1)).alias("n"))


def three_way_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = matching.three_way(derived.invoice_lines(spark, sf_dir), derived.order_lines(spark, sf_dir), derived.receipt_lines(spark, sf_dir))
    return d.groupBy("id", "type", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("difference").cast(MONEY).alias("difference"))


def contracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.array(F.concat(F.lit("Customer "), F.col("c_custkey"), F.lit(" Inc.")), F.lit("Seller 1 Ltd"), F.lit("Seller 2 Ltd")).alias("parties"),
        F.lit("1994-01-01").cast("date").alias("effective_date"), F.when(F.col("c_custkey") % 4 != 0, F.lit("1997-12-31").cast("date")).alias("expiration_date"),
        F.lit("EUR").alias("currency"), (F.col("c_acctbal").cast(MONEY) * 150).cast(MONEY).alias("contract_value"),
    )
    i = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("number"), F.concat(F.lit("SELLER "), F.col("o_orderkey") % 3).alias("seller"),
        F.concat(F.lit("customer "), F.col("o_custkey")).alias("buyer"), F.to_date("o_orderdate").alias("issue_date"),
        F.when(F.col("o_orderkey") % 50 == 0, "usd").otherwise("eur").alias("currency"), F.col("o_totalprice").cast(MONEY).alias("total"),
    )
    return c, i


def contract_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.contract_budget(*contracts(spark, sf_dir))[1]


def contract_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.contract_budget(*contracts(spark, sf_dir))[0].groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))


def payments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.to_date("ts").alias("date"), (F.col("user_id") % 3).cast("string").alias("currency"),
        F.when(F.col("user_id") % 4 != 0, (F.col("user_id") % 10).cast("string")).alias("card"), F.col("value").cast(MONEY).alias("v"),
    )
    receipts = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "date", "currency", "card", F.col("v").alias("total"))
    bank = e.where("event_type <> 'purchase'").select(F.col("event_id").alias("transaction_id"), F.col("event_id").alias("ordinal"), "date", "currency", "card", (-F.col("v")).cast(MONEY).alias("amount"))
    return receipts, bank


def receipt_bank_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.receipt_to_transactions(*payments(spark, sf_dir))


def receipt_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts, bank = payments(spark, sf_dir)
    none = matching.receipt_to_transactions(receipts, bank).where("status = 'unmatched'").select("id")
    return receipts.join(none, "id", "left_semi").select("id", "date", "currency", "total")


def corroborated_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubts about a receipt's total go where a bank transaction confirms it."""
    receipts, bank = payments(spark, sf_dir)
    reasons = receipts.select("id", F.lit("low_confidence").alias("code"), F.lit("total_amount").alias("field")).unionByName(
        receipts.where("id % 5 = 0").select("id", F.lit("validation_error").alias("code"), F.lit("items").alias("field"))
    )
    sure = matching.receipt_to_transactions(receipts, bank).where("status = 'matched'").select("id", F.lit("total_amount").alias("field"))
    return matching.corroborate(reasons, sure)


def dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to process again: those whose content id is not among the documents of even id that did not fail."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.concat(F.lit("doc_"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 20)).alias("document_id"))
    before = d.where("doc_id % 2 = 0").select("source", "document_id", F.when(F.col("doc_id") % 10 == 0, "failed").otherwise("succeeded").alias("status"))
    return matching.changed_sources(d, before).select("doc_id", "source", "document_id")


def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.col("value").cast(MONEY).alias("value"))
    return matching.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def path_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    flat = lambda df: df.select(F.col("o_orderkey").alias("id"), F.explode(F.map_from_arrays(F.array(F.lit("/status"), F.lit("/priority"), F.lit("/customer")), F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")))).alias("path", "value"))
    after = flat(o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))).where("not (path = '/priority' and id % 7 = 0)")
    return matching.path_diff(flat(o), after)


QUERIES = {f.__name__: f for f in (
    po_match_lines, po_match_status, po_header_discrepancies, unordered_items, three_way_discrepancies, contract_budget, contract_breaches,
    receipt_bank_match, receipt_unmatched, corroborated_reasons, dedupe_content, latest_per_source, path_diff,
)}

LINES = derived.SQL + """,
bs as (select id, sku k, quantity q, unit_price p from (select *, row_number() over (partition by id, sku order by pos desc) r from ord where sku is not null) where r = 1),
bd as (select id, description d, quantity q, unit_price p from (select *, row_number() over (partition by id, description order by pos desc) r from ord) where r = 1),
m as (select i.*, case when bs.k is not null then bs.q else bd.q end oq, case when bs.k is not null then bs.p else bd.p end op
  from inv i left join bs on i.id = bs.id and i.sku = bs.k left join bd on i.id = bd.id and i.description = bd.d),
ld as (select id, 'unordered_item' type, 0 qq, cast(null as decimal(18,2)) difference from m where oq is null
  union all select id, 'quantity_overbilling', 1, quantity - oq from m where quantity > oq * {q} and abs(quantity - oq) > 0.01
  union all select id, 'price_variance', 0, unit_price - op from m where unit_price > op and abs(unit_price - op) > 0.01)
"""
HEAD = """,
h as (select hi.*, ho.po_number op, ho.seller os, ho.buyer ob, ho.total ot, o_custkey from hi join ho using (id) join orders on o_orderkey = hi.id),
hd as (select id, 'po_number_mismatch' type, 'purchase_order_number' field, op expected, po_number actual, cast(null as decimal(18,2)) difference from h where lower(po_number) <> op
  union all select id, 'currency_mismatch', 'currency', 'EUR', currency, null from h where upper(currency) <> 'EUR'
  union all select id, 'party_mismatch', 'seller.name', upper(os), 'Supplier ' || (o_custkey % 7) || ' GmbH', null from h where seller <> os
  union all select id, 'total_mismatch', 'total_amount', cast(ot as varchar), cast(total as varchar), total - ot from h where total > ot and total - ot > 0.01)
"""
CONTRACT = """
with c as (select c_custkey id, date '1994-01-01' f, case when c_custkey % 4 <> 0 then date '1997-12-31' end u, cast(cast(c_acctbal as decimal(18,2)) * 150 as decimal(18,2)) v from customer),
i as (select o_custkey id, o_orderkey n, cast(o_orderdate as date) d, cast(o_totalprice as decimal(18,2)) t from orders)
"""
PAY = """
with e as (select event_id, event_type, cast(ts as date) d, cast(user_id % 3 as varchar) currency, case when user_id % 4 <> 0 then cast(user_id % 10 as varchar) end card, cast(value as decimal(18,2)) v from events),
r as (select event_id id, d, currency, card, v from e where event_type = 'purchase'),
t as (select event_id tid, d, currency, card, v from e where event_type <> 'purchase'),
hit as (select r.id, t.tid, row_number() over (partition by r.id order by case when t.d = r.d then 0 else 1 end, t.tid) k, count(*) over (partition by r.id) n
  from r join t on r.currency = t.currency and abs(date_diff('day', r.d, t.d)) <= 3 and abs(r.v - t.v) <= 0.05 and (r.card is null or t.card is null or r.card = t.card))
"""
ORACLE = {
    "po_match_lines": LINES.format(q="1.02") + "select id, type, count(*) n, cast(sum(difference) as decimal(18,2)) difference from ld group by 1, 2",
    "po_header_discrepancies": derived.SQL + HEAD + "select id, type, field, expected, actual, cast(difference as decimal(18,2)) difference, 'error' severity from hd",
    "po_match_status": LINES.format(q="1") + HEAD + """, alld as (select id from ld union all select id from hd), n as (select id, count(*) n from alld group by 1)
select h.id, case when n.n > 0 then 'discrepancy' else 'matched' end status, least(h.total, h.ot) matched_amount, cast(abs(h.total - h.ot) as decimal(19,2)) variance_amount, coalesce(n.n, 0) n_discrepancies
from h left join n on h.id = n.id""",
    "unordered_items": derived.SQL + "select id, description d, count(*) n from inv where not exists (select 1 from ord where ord.id = inv.id and ord.description = inv.description) group by 1, 2",
    "three_way_discrepancies": derived.SQL + """,
k as (select *, coalesce(sku, description) key from inv),
w as (select id, key, quantity q from (select *, coalesce(sku, description) key, row_number() over (partition by id, coalesce(sku, description) order by pos desc) r from rec) where r = 1),
o as (select id, key, unit_price p from (select *, coalesce(sku, description) key, row_number() over (partition by id, coalesce(sku, description) order by pos desc) r from ord) where r = 1),
m as (select k.*, w.q, o.p, w.key wk, o.key ok from k left join w on k.id = w.id and k.key = w.key left join o on k.id = o.id and k.key = o.key),
d as (select id, 'unfulfilled_billing' type, 'line_items' field, cast(null as decimal(18,2)) difference from m where wk is null
  union all select id, 'unfulfilled_billing', 'line_items.quantity', quantity - q from m where quantity > q and quantity - q > 0.01
  union all select id, 'unordered_item', 'line_items', null from m where ok is null
  union all select id, 'price_variance', 'line_items.unit_price', unit_price - p from m where unit_price > p and unit_price - p > 0.01)
select id, type, field, count(*) n, cast(sum(difference) as decimal(18,2)) difference from d group by 1, 2, 3""",
    "contract_budget": CONTRACT + """, b as (select id, cast(sum(t) as decimal(18,2)) billed, count(*) n from i group by 1)
select c.id, cast(coalesce(billed, 0) as decimal(18,2)) billed, coalesce(n, 0) n_invoices, coalesce(billed, 0) > v and coalesce(billed, 0) - v > 0.01 exceeded,
 cast(case when coalesce(billed, 0) > v and coalesce(billed, 0) - v > 0.01 then coalesce(billed, 0) - v else 0 end as decimal(18,2)) variance,
 cast(case when coalesce(billed, 0) > v and coalesce(billed, 0) - v > 0.01 then v else coalesce(billed, 0) end as decimal(18,2)) matched_amount from c left join b using (id)""",
    "contract_breaches": CONTRACT + """select id, type, count(*) n from (
 select id, 'party_mismatch' type from i where n % 3 = 0 and id in (select id from c)
 union all select i.id, 'date_out_of_bounds' from i join c using (id) where d < f
 union all select i.id, 'date_out_of_bounds' from i join c using (id) where d > u
 union all select id, 'currency_mismatch' from i where n % 50 = 0 and id in (select id from c)) group by 1, 2""",
    "receipt_bank_match": PAY + """select r.id, case when hit.n is null then 'unmatched' else 'matched' end status, coalesce(hit.n, 0) n_candidates, tid transaction_id, coalesce(hit.n > 1, false) warning
 from r left join hit on r.id = hit.id and hit.k = 1""",
    "receipt_unmatched": PAY + "select id, d date, currency, v total from r where id not in (select id from hit)",
    "corroborated_reasons": PAY + """select id, 'low_confidence' code, 'total_amount' field from r where id not in (select id from hit)
 union all select id, 'validation_error', 'items' from r where id % 5 = 0""",
    "dedupe_content": """with d as (select doc_id, source, 'doc_' || substr(sha256(text), 1, 20) document_id from documents)
select * from d where not exists (select 1 from d b where b.doc_id % 2 = 0 and b.doc_id % 10 <> 0 and b.source = d.source and b.document_id = d.document_id)""",
    "latest_per_source": "select user_id, event_id, event_type, cast(value as decimal(18,2)) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1",
    "path_diff": """with b as (select o_orderkey id, unnest(['/status', '/priority', '/customer']) path, unnest([o_orderstatus, o_orderpriority, cast(o_custkey as varchar)]) v from orders),
a as (select id, path, case when path = '/status' and id % 3 = 0 then 'X' else v end v from b where not (path = '/priority' and id % 7 = 0))
select coalesce(a.id, b.id) id, coalesce(a.path, b.path) path, b.v old, a.v as new from b full join a on a.id = b.id and a.path = b.path where a.v is distinct from b.v""",
}
