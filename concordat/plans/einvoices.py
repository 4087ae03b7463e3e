"""Queries of e-invoices: written from typed documents and read back from their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.functions import text
from concordat.operators import backends, einvoice, schema_gate
from concordat.sources import readers
from concordat.session import spread, table

MONEY = "decimal(18,2)"


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as typed invoices at 19 %, some with a second rate, a discount, a wrong tax or a wrong subtotal."""
    k = F.col("l_orderkey")
    low = (k % 13 == 0) & (F.col("l_linenumber") % 2 == 0)
    q, net = F.col("l_quantity").cast(MONEY), F.col("l_extendedprice").cast(MONEY)
    line = F.struct("l_linenumber", F.concat(F.lit("Part <"), "l_partkey", F.lit("> & Co")).alias("description"), q.alias("quantity"), (net / 2).cast(MONEY).alias("unit_price"), net.alias("total"), F.when(F.col("l_linenumber") == 1, "kg").alias("unit_of_measure"), F.when(low, 7).alias("tax_rate_percent"))
    cents = lambda c: F.round(c, 2).cast(MONEY)
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), "l_orderkey").groupBy(k.alias("k")).agg(
        F.array_sort(F.collect_list(line)).alias("line_items"), F.sum(net).cast(MONEY).alias("s"), F.coalesce(F.sum(F.when(low, net)), F.lit(0)).cast(MONEY).alias("lower"), F.max(low).alias("some"), F.min(low).alias("every")
    )
    k = F.col("k")
    off = F.when(k % 5 == 0, F.lit("1.00")).otherwise("0.00").cast(MONEY)
    base = F.col("s") - off
    tax = F.when(F.col("every"), cents(base * 7 / 100)).when(F.col("some"), cents(F.col("lower") * 7 / 100) + cents((F.col("s") - F.col("lower")) * 19 / 100)).otherwise(cents(base * 19 / 100))
    tax = (tax + F.when(k % 7 == 0, F.lit("0.05")).otherwise("0").cast(MONEY)).cast(MONEY)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").cast("string").alias("issue_date"))
    o = spread(o, "k").join(li, "k")
    person = lambda name, vat: F.struct(F.lit(name).alias("name"), F.array(F.struct(vat.alias("value"), F.lit("vat").alias("scheme"))).alias("tax_ids"), F.struct(F.lit("Kiel").alias("city"), F.lit("DE").alias("country_code")).alias("address"))
    doc = F.struct(
        F.concat(F.lit("I-"), k).alias("invoice_number"), "issue_date", person("Nord & Söhne", F.lit("DE 136 695 976")).alias("seller"), person("Buyer", F.when(k % 2 == 0, "DK13585628")).alias("buyer"), F.lit("eur").alias("currency"),
        "line_items", (F.col("s") + F.when(k % 11 == 0, 1).otherwise(0)).cast(MONEY).alias("subtotal"), F.lit(19).alias("tax_rate_percent"), tax.alias("tax_amount"), off.alias("discount_amount"), (base + tax).cast(MONEY).alias("total_amount"),
        F.when(k % 3 == 0, F.struct(F.lit("DE89 3704 0044 0532 0130 00").alias("iban"))).alias("payment_account"), F.array(F.struct(F.lit("purchase_order").alias("kind"), F.concat(F.lit("PO"), k).alias("number"))).alias("references"),
    )
    return o.select(k.alias("doc_id"), F.from_json(F.to_json(doc), schema_gate.kind_of(schema_gate.TREES["invoice"])).alias("value"))


def round_trip(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """Labels read from the written text, or the refusal."""
    x = einvoice.render(einvoice.semantic(invoices(spark, sf_dir)), profile).select("doc_id", "refusal", "xml")
    read = readers.einvoice_labels(F.col("xml"))
    wanted = ("number", "issue_date", "currency", "seller", "buyer", "seller_vat", "order_reference", "iban", "line_total", "tax", "total", "n_lines", "n_rates")
    return x.select("doc_id", "refusal", *[read[c].alias(c) for c in wanted])


def ubl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, "peppol")


def cii_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, sf_dir, "factur-x-en16931")


def backend_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, read by a text layer that fails on some, an engine's kept answers and a last resort."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("page")
    conf = lambda n: ((k % n) / 10).cast("double").alias("confidence")
    r = backends.Registry()
    r.add(backends.Backend("engine", lambda pages: pages, lambda: "no program"))
    r.add(backends.Backend("layer", lambda pages: pages.where(k % 5 != 0).select("page", F.when(k % 3 == 0, "(cid:1) (cid:2) (cid:3) (cid:4)").otherwise(F.col("text")).alias("text"), conf(7))))
    r.add(backends.recorded("kept", d.where(k % 2 == 0).select("page", "text", conf(6))))
    r.add(backends.Backend("last", lambda pages: pages.select("page", F.lit("?").alias("text"), conf(9))))
    read = backends.read_pages(d, r.chain("auto, kept, last, kept"), lambda t, c: text.quality_ok(t) & (c > 0.05))
    return read.groupBy("backend", "attempts").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (ubl_documents, cii_documents, backend_chain)}

#: Half up to cents, in whole numbers: the amount has two digits, the percentage none.
PART = "cast((cast({a} * 100 as hugeint) * {p} + 50) // 100 * 0.01 as decimal(18,2))"
LABELS = f"""with l as (select l_orderkey k, cast(l_extendedprice as decimal(18,2)) net, l_orderkey % 13 = 0 and l_linenumber % 2 = 0 low from lineitem),
s as (select k, cast(sum(net) as decimal(18,2)) s, cast(coalesce(sum(net) filter (low), 0) as decimal(18,2)) lower_, bool_or(low) some_, bool_and(low) every_, count(*) n from l group by 1),
b as (select *, cast(s - case when k % 5 = 0 then 1 else 0 end as decimal(18,2)) base, cast(s - lower_ as decimal(18,2)) upper_ from s),
t as (select *, case when every_ then {PART.format(a='base', p=7)} when some_ then {PART.format(a='lower_', p=7)} + {PART.format(a='upper_', p=19)} else {PART.format(a='base', p=19)} end right_ from b),
r as (select *, case when some_ and not every_ and k % 5 = 0 then 'mixed rates' when k % 7 = 0 then 'tax' when k % 11 = 0 then 'BR-CO-10' end refusal from t)
select k doc_id, refusal, case when refusal is null then 'I-' || k end number, case when refusal is null then cast(o_orderdate as date) end issue_date, case when refusal is null then 'EUR' end currency, case when refusal is null then 'Nord & Söhne' end seller,
 case when refusal is null then 'Buyer' end buyer, case when refusal is null then 'DE136695976' end seller_vat, case when refusal is null then 'PO' || k end order_reference, case when refusal is null and k % 3 = 0 then 'DE89370400440532013000' end iban,
 case when refusal is null then s end line_total, case when refusal is null then right_::decimal(18,2) end tax, case when refusal is null then (base + right_)::decimal(18,2) end total, case when refusal is null then n::int end n_lines,
 case when refusal is null then case when some_ and not every_ then 2 else 1 end end n_rates from r join orders on o_orderkey = k"""
ORACLE = {
    "ubl_documents": LABELS, "cii_documents": LABELS,
    "backend_chain": """with d as (select doc_id k, coalesce(text, '') t from documents), g as (select *, length(trim(t)) >= 20 and (length(t) - length(replace(t, '(cid:', ''))) = 0 good from d),
b as (select *, k % 5 <> 0 has_layer, k % 2 = 0 has_kept, (k % 7) / 10.0 c1, (k % 6) / 10.0 c2, (k % 9) / 10.0 c3 from g),
c as (select *, case when has_layer and k % 3 <> 0 and good and k % 7 > 0 then 'layer' when has_kept and good and k % 6 > 0 then 'kept' end accepted from b),
f as (select *, case accepted when 'layer' then 1 when 'kept' then 2 else 3 end attempts, case when accepted is not null then accepted
  when has_layer and c1 >= c3 and (not has_kept or c1 >= c2) then 'layer' when has_kept and c2 >= c3 then 'kept' else 'last' end backend from c)
select backend, attempts, count(*) n, sum(case backend when 'layer' then case when k % 3 = 0 then 31 else length(t) end when 'kept' then length(t) else 1 end)::bigint chars from f group by 1, 2""",
}
