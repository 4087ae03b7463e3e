"""Reconciliation across documents: invoice and order, three-way, contract budget, receipt and bank transaction.

Inputs are tables of headers and of lines; outputs are long tables of discrepancies
(id, type, field, expected, actual, difference, severity) and one status row for each
document. Amounts are decimals. Lines carry ``pos``, any orderable column that fixes their
order within a document: where a key repeats, the last line of the order holds.

Both sides of every join are reduced to one row a key before it, so no join multiplies
rows; sizes and adaptive execution choose between broadcast and sort-merge.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from concordat.functions import money, text

#: Transactions of all cards together, among those of single cards; no card is written so.
ANY = "\x00any"
SHAPE = ("id", "type", "field", "expected", "actual", "difference", "severity")


def key_of(c: Column) -> Column:
    return F.lower(F.trim(c))


def discrepancy(kind: str, field: Column | str, expected: Column, actual: Column, difference: Column | None = None, severity: str = "error") -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    none = F.lit(None).cast("decimal(18,2)")
    return F.struct(
        F.lit(kind).alias("type"), field.alias("field"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"),
        (none if difference is None else money.cents(difference)).alias("difference"), F.lit(severity).alias("severity"),
    )


def long(df: DataFrame, *found: Column) -> DataFrame:
    """One row for each of the structs that is not null."""
    return df.select("id", F.explode(F.array_compact(F.array(*found))).alias("d")).select("id", "d.*")


def last_by(lines: DataFrame, *keys: str) -> DataFrame:
    """The last line of each key, by one aggregation instead of a sort."""
    rest = [c for c in lines.columns if c not in keys]
    return lines.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("pos")).alias("line")).select(*keys, "line.*")


def matched_lines(invoice_lines: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Invoice lines with their order line: by SKU, else by description; a SKU the order lacks falls back to the description.

    Columns: id, pos, sku, description, quantity, unit_price, and o_quantity, o_unit_price (null where nothing matches).
    """
    o = order_lines.select("id", "pos", key_of(F.col("sku")).alias("k"), key_of(F.col("description")).alias("d"), F.col("quantity").alias("q"), F.col("unit_price").alias("p"))
    by_sku = last_by(o.where("k is not null and k <> ''").select("id", "k", "pos", "q", "p"), "id", "k").select("id", "k", F.struct("q", "p").alias("s"))
    by_text = last_by(o.where("d is not null").select("id", "d", "pos", "q", "p"), "id", "d").select("id", "d", F.struct("q", "p").alias("t"))
    i = invoice_lines.withColumn("k", key_of(F.col("sku"))).withColumn("d", key_of(F.col("description")))
    x = i.join(by_sku, ["id", "k"], "left").join(by_text, ["id", "d"], "left").withColumn("o", F.coalesce("s", "t"))
    return x.select("id", "pos", "sku", "description", "quantity", "unit_price", F.col("o.q").alias("o_quantity"), F.col("o.p").alias("o_unit_price"))


def line_discrepancies(lines: DataFrame, price_percent: float = 0.0, quantity_percent: float = 0.0) -> DataFrame:
    q, p = F.col("quantity"), F.col("unit_price")
    missing = F.col("o_quantity").isNull() & F.col("o_unit_price").isNull()
    return long(
        lines,
        F.when(missing, discrepancy("unordered_item", "line_items", F.lit(None), F.col("description"))),
        F.when(money.exceeds(q, F.col("o_quantity"), quantity_percent), discrepancy("quantity_overbilling", "line_items.quantity", F.col("o_quantity"), q, q - F.col("o_quantity"))),
        F.when(money.exceeds(p, F.col("o_unit_price"), price_percent), discrepancy("price_variance", "line_items.unit_price", F.col("o_unit_price"), p, p - F.col("o_unit_price"))),
    )


def invoice_to_order(
    invoices: DataFrame, invoice_lines: DataFrame, orders: DataFrame, order_lines: DataFrame, *,
    price_percent: float = 0.0, quantity_percent: float = 0.0, guarded: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(discrepancies, statuses). Headers: id, po_number, currency, seller, buyer, total; orders join by id.

    ``guarded`` compares names only where a core name is left; without it two names in other
    scripts compare equal, as the plain rule has it.
    """
    sides = ("po_number", "currency", "seller", "buyer", "total")
    cores = lambda df: df.withColumns({f"{c}_core": text.core_name(F.col(c)) for c in ("seller", "buyer")})
    o = cores(orders).select("id", *[F.col(c).alias(f"o_{c}") for c in (*sides, "seller_core", "buyer_core")])
    h = cores(invoices).join(o, "id")
    differ = lambda c: (F.col(f"{c}_core") != F.col(f"o_{c}_core")) & (F.lit(not guarded) | (F.col(f"{c}_core") != "") | (F.col(f"o_{c}_core") != ""))
    head = F.array_compact(F.array(
        F.when((F.coalesce(F.col("po_number"), F.lit("")) != "") & (key_of(F.col("po_number")) != key_of(F.col("o_po_number"))), discrepancy("po_number_mismatch", "purchase_order_number", F.col("o_po_number"), F.col("po_number"))),
        F.when(F.upper("currency") != F.upper("o_currency"), discrepancy("currency_mismatch", "currency", F.col("o_currency"), F.col("currency"))),
        F.when(differ("seller"), discrepancy("party_mismatch", "seller.name", F.col("o_seller"), F.col("seller"))),
        F.when(differ("buyer"), discrepancy("party_mismatch", "buyer.name", F.col("o_buyer"), F.col("buyer"))),
        F.when(money.exceeds(F.col("total"), F.col("o_total")), discrepancy("total_mismatch", "total_amount", F.col("o_total"), F.col("total"), F.col("total") - F.col("o_total"))),
    ))
    h = h.select("id", "total", "o_total", head.alias("head"))
    lines = line_discrepancies(matched_lines(invoice_lines, order_lines), price_percent, quantity_percent)
    return h.select("id", F.explode("head").alias("d")).select("id", "d.*").unionByName(lines), statuses(h, lines)


def statuses(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """id, status, matched_amount, variance_amount, n_discrepancies from headers (total, o_total, own discrepancies in ``head``) and lines' ones."""
    errors = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("severity") == "error", 1).otherwise(0)).alias("bad"))
    x = headers.join(errors, "id", "left")
    bad = (F.coalesce("bad", F.lit(0)) == 1) | F.exists("head", lambda d: d["severity"] == "error")
    return x.select(
        "id", F.when(bad, "discrepancy").otherwise("matched").alias("status"),
        F.least("total", "o_total").alias("matched_amount"), F.abs(F.col("total") - F.col("o_total")).alias("variance_amount"),
        (F.coalesce("n", F.lit(0)) + F.size("head")).cast("long").alias("n_discrepancies"),
    )


def three_way(invoice_lines: DataFrame, order_lines: DataFrame, receipt_lines: DataFrame, *, price_percent: float = 0.0, quantity_percent: float = 0.0) -> DataFrame:
    """Discrepancies of invoice lines against order (authorised, price) and goods receipt (delivered quantity).

    The key of a line is its SKU if it has one, else its description: here a SKU on one side
    and a description on the other never meet.
    """
    key = F.when(F.coalesce(F.col("sku"), F.lit("")) != "", key_of(F.col("sku"))).otherwise(key_of(F.col("description")))
    one = lambda df, c, name: last_by(df.select("id", key.alias("k"), "pos", F.struct(F.col(c).alias("v")).alias(name)), "id", "k").drop("pos")
    x = invoice_lines.withColumn("k", key).join(one(receipt_lines, "quantity", "w"), ["id", "k"], "left").join(one(order_lines, "unit_price", "o"), ["id", "k"], "left")
    q, p, w, o = F.col("quantity"), F.col("unit_price"), F.col("w.v"), F.col("o.v")
    return long(
        x,
        F.when(F.col("w").isNull(), discrepancy("unfulfilled_billing", "line_items", F.lit("0"), q)),
        F.when(money.exceeds(q, w, quantity_percent), discrepancy("unfulfilled_billing", "line_items.quantity", w, q, q - w)),
        F.when(F.col("o").isNull(), discrepancy("unordered_item", "line_items", F.lit(None), F.col("description"))),
        F.when(money.exceeds(p, o, price_percent), discrepancy("price_variance", "line_items.unit_price", o, p, p - o)),
    )


def contract_budget(contracts: DataFrame, invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(breaches by invoice, budget by contract).

    contracts: id, parties (array of names), effective_date, expiration_date, currency, contract_value.
    invoices: id (of the contract), number, seller, buyer, issue_date, currency, total.
    The sum is over all invoices given, whatever their currency; currencies are flagged beside it.
    """
    c = contracts.select("id", F.transform("parties", text.core_name).alias("cores"), "effective_date", "expiration_date", F.col("currency").alias("c_currency"), "contract_value")
    x = invoices.join(c, "id")
    at = lambda name: F.concat(F.lit("invoices["), F.col("number"), F.lit(f"].{name}"))
    party = lambda n: F.when(~F.array_contains("cores", text.core_name(F.col(n))), discrepancy("party_mismatch", at(f"{n}.name"), F.lit(None), F.col(n)))
    breaches = long(
        x, party("seller"), party("buyer"),
        F.when(F.col("issue_date") < F.col("effective_date"), discrepancy("date_out_of_bounds", at("issue_date"), F.col("effective_date"), F.col("issue_date"))),
        F.when(F.col("issue_date") > F.col("expiration_date"), discrepancy("date_out_of_bounds", at("issue_date"), F.col("expiration_date"), F.col("issue_date"))),
        F.when(F.upper("currency") != F.upper("c_currency"), discrepancy("currency_mismatch", at("currency"), F.col("c_currency"), F.col("currency"))),
    )
    billed = invoices.groupBy("id").agg(F.sum("total").cast("decimal(18,2)").alias("billed"), F.count(F.lit(1)).alias("n_invoices"))
    over = money.exceeds(F.col("billed"), F.col("contract_value"))
    budget = contracts.select("id", "contract_value").join(billed, "id", "left").withColumn("billed", F.coalesce("billed", F.lit(0).cast("decimal(18,2)"))).select(
        "id", "billed", F.coalesce("n_invoices", F.lit(0)).cast("long").alias("n_invoices"), F.coalesce(over, F.lit(False)).alias("exceeded"),
        F.when(over, F.col("billed") - F.col("contract_value")).otherwise(F.lit(0)).cast("decimal(18,2)").alias("variance"),
        F.when(over, F.col("contract_value")).otherwise(F.col("billed")).cast("decimal(18,2)").alias("matched_amount"),
    )
    return breaches, budget


def receipt_to_transactions(receipts: DataFrame, transactions: DataFrame, *, days: int = 3, tolerance: str = "0.05") -> DataFrame:
    """id, status, n_candidates, transaction_id, warning for every receipt.

    receipts: id, date, currency, card (or null), total. transactions: transaction_id, ordinal,
    date, currency, card, amount. A candidate has the currency, the card where both know one,
    a date within ``days`` and the amount within ``tolerance``, whatever its sign.

    Receipts that agree in all of this are one cell, and so are transactions of the same day, currency, card and amount: cells
    meet, not rows, so a day with very many transactions costs its distinct amounts within the tolerance. The range join is an
    equality join: a cell of receipts goes to the 2 * days + 1 days around it, to the buckets of its amounts (two at most) and to
    its own card and the unknown one; without a card it meets transactions summed over all cards. Of several candidates the
    first of the same day is taken, else the first in order.
    """
    tol = F.lit(tolerance).cast("decimal(10,4)")
    width = F.lit(str(max(2 * Decimal(tolerance), Decimal("0.01")))).cast("decimal(10,4)")
    bucket = lambda c: F.floor(F.greatest(c, F.lit(0)) / width).cast("bigint")
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    total = F.col("total")
    rows = receipts.select("id", "date", F.upper("currency").alias("cur"), known("card").alias("card"), "total").where("date is not null and cur is not null and total is not null")
    r = rows.select("date", "cur", "card", "total").distinct().select(
        "*", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("day"), F.sequence(bucket(total - tol), bucket(total + tol)).alias("near"), F.when(F.col("card") == "", F.array(F.lit(ANY))).otherwise(F.array("card", F.lit(""))).alias("cards")
    ).withColumn("bucket", F.explode("near")).withColumn("met", F.explode("cards")).drop("near", "cards")
    t = transactions.select(F.col("date").alias("day"), F.upper("currency").alias("cur"), known("card").alias("met"), F.abs("amount").alias("amount"), F.struct("ordinal", "transaction_id").alias("first"))
    t = t.groupBy("day", "cur", "met", "amount").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    # A second row for all cards together; the sums over it stay as many as the amounts of a day.
    every = t.groupBy("day", "cur", "amount").agg(F.sum("n").alias("n"), F.min("first").alias("first")).select("day", "cur", F.lit(ANY).alias("met"), "amount", "n", "first")
    t = t.unionByName(every).withColumn("bucket", bucket(F.col("amount")))
    hit = r.join(t, ["cur", "day", "bucket", "met"]).where(F.abs(total - F.col("amount")) <= tol)
    cells = hit.groupBy("date", "cur", "card", "total").agg(F.sum("n").alias("n"), F.min(F.struct((F.col("day") != F.col("date")).alias("off"), "first")).alias("first"))
    best = rows.join(cells, ["date", "cur", "card", "total"]).groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first")).select("id", "n", F.col("first.first.transaction_id").alias("transaction_id"))
    return receipts.select("id").join(best, "id", "left").select(
        "id", F.when(F.col("n").isNull(), "unmatched").otherwise("matched").alias("status"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), "transaction_id", F.coalesce(F.col("n") > 1, F.lit(False)).alias("warning"),
    )


def corroborate(reasons: DataFrame, evidence: DataFrame) -> DataFrame:
    """Review reasons (id, code, field, text) less the doubts about fields that other documents confirm (id, field)."""
    doubt = F.col("code") == "low_confidence"
    sure = evidence.select("id", "field").distinct()
    return reasons.where(~doubt | doubt.isNull()).unionByName(reasons.where(doubt).join(sure, ["id", "field"], "left_anti").select(*reasons.columns))


def changed_sources(now: DataFrame, before: DataFrame) -> DataFrame:
    """Sources whose content is new, changed, or failed before: (source, document_id) against the latest results."""
    done = before.where("status <> 'failed'").select("source", "document_id").distinct()
    return now.join(done, ["source", "document_id"], "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by one aggregation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*key, "__row.*")


def path_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, path, old, new) of all paths whose values differ."""
    x = before.select("id", "path", F.col("value").alias("old")).join(after.select("id", "path", F.col("value").alias("new")), ["id", "path"], "full_outer")
    return x.where(~F.col("old").eqNullSafe(F.col("new")))


def ranked(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
