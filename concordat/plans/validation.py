"""Queries of the rules and of the functions under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concordat.functions import checks, dates, language, money, text
from concordat.operators import validation
from concordat.plans import derived
from concordat.session import table

MONEY = "decimal(18,2)"
AS_OF = "1998-06-01"


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested invoices: an order with its lines; subtotal and tax follow from the order's total by rule."""
    item = F.struct(
        "pos", F.col("description"), F.col("quantity"), (F.col("unit_price") / 10).cast(MONEY).alias("unit_price"),
        (F.col("quantity") * (F.col("unit_price") / 10).cast(MONEY) + F.when(F.col("flag") == "R", F.lit("0.02")).when(F.col("flag") == "A", F.lit("0.01")).otherwise(F.lit("0")).cast(MONEY)).cast(MONEY).alias("total"),
        F.lit(None).cast("decimal(6,2)").alias("tax_rate_percent"), F.array().cast("array<decimal(28,6)>").alias("discounts"), "shipdate",
    )
    li = derived.lines(spark, sf_dir).select("id", item.alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("line_items"))
    o = table(spark, sf_dir, "orders")
    total, key = F.col("o_totalprice").cast(MONEY), F.col("o_orderkey")
    sub = validation.total_of(F.col("line_items"), "total").cast(MONEY)
    # Identifiers of some invoices, right and wrong ones.
    iban = F.when(key % 13 == 0, iban_text(key)).when(key % 13 == 1, F.concat(F.lit("US"), F.lpad(key.cast("string"), 20, "0"))).when(key % 13 == 2, "XX12")
    bic = F.when(key % 17 == 0, "BADBIC").when(key % 17 == 1, "COBADEFFXXX")
    ids = lambda *x: F.array(F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("value", "scheme", "country_code"), strict=True)]))
    no_ids = F.array().cast("array<struct<value:string,scheme:string,country_code:string>>")
    seller_ids = F.when(key % 19 == 0, ids("DK13585627", "vat", "DK")).when(key % 19 == 1, ids("DK13585628", "vat", "DK")).when(key % 19 == 2, ids("CZ12345678", "vat", "CZ")).otherwise(no_ids)
    buyer_ids = F.when(key % 23 == 0, ids("12-3456789", "tax", "US")).when(key % 23 == 1, ids("07-3456789", "tax", "US")).otherwise(no_ids)
    return o.join(li, F.col("o_orderkey") == F.col("id")).select(
        key.alias("doc_id"), F.when(key % 101 == 0, " ").otherwise(key.cast("string")).alias("number"), F.to_date("o_orderdate").alias("issue_date"),
        F.array_min(F.transform("line_items", lambda x: x["shipdate"])).alias("due_date"), iban.alias("iban"), bic.alias("bic"),
        F.concat(F.lit("Company "), F.col("o_custkey") % 5).alias("seller"), F.concat(F.lit("COMPANY "), key % 5, F.lit(" Inc.")).alias("buyer"),
        (sub + F.when(key % 7 == 0, F.lit("0.02")).when(key % 7 == 1, F.lit("0.01")).otherwise(F.lit("0")).cast(MONEY)).cast(MONEY).alias("subtotal"),
        F.when(key % 2 == 0, 10).otherwise(20).cast("decimal(6,2)").alias("tax_rate_percent"), (sub / 10).cast(MONEY).alias("tax_amount"),
        F.lit(None).cast(MONEY).alias("shipping_amount"), F.lit(None).cast(MONEY).alias("discount_amount"),
        (sub + (sub / 10).cast(MONEY) + F.when(key % 9 == 0, 1).otherwise(0)).cast(MONEY).alias("total_amount"),
        F.array().cast("array<decimal(28,6)>").alias("page_rates"), "line_items",
        seller_ids.alias("seller_tax_ids"), buyer_ids.alias("buyer_tax_ids"),
    )


def invoice_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by rule and severity over all invoices."""
    found = validation.issues(invoices(spark, sf_dir), "invoice", validation.Context(as_of=AS_OF))
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def line_sum_vs_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the lines after discount and tax against the order's total, for orders that have lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast(MONEY).alias("e"))
    s = li.groupBy("l_orderkey").agg(F.sum("e").cast("decimal(20,2)").alias("line_sum"), F.count(F.lit(1)).alias("n_lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("total"))
    return o.join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "total", "line_sum", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(money.close(F.col("line_sum"), F.col("total")), F.lit(False)).alias("agrees")
    )


def line_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose extended price is not quantity times the part's retail price, plainly or after the row's discount."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q, p, e = F.col("l_quantity").cast(MONEY), F.col("p_retailprice").cast(MONEY), F.col("l_extendedprice").cast(MONEY)
    d = F.array((F.col("l_discount").cast("decimal(6,2)") * 100).cast("decimal(28,6)"))
    none = F.array().cast("array<decimal(28,6)>")
    return li.select("l_orderkey", "l_partkey", "l_linenumber", money.line_explained(q, p, e, d, none).alias("explained"), F.abs(q * p - e).cast(MONEY).alias("off"))


def rate_vs_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    e, r, d = F.col("l_extendedprice").cast(MONEY), F.col("l_tax").cast("decimal(6,2)"), F.col("l_discount").cast("decimal(6,2)")
    want, stated = money.cents(e * r), money.cents(e * d)
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(~money.close(want, stated, "0.05")).alias("off"))


def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of each user after every event; purchases take, others give."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").withColumn("amount", (F.col("value").cast(MONEY) * F.when(F.col("event_type") == "purchase", -1).otherwise(1)).cast(MONEY))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", "user_id", F.sum("amount").over(w).cast("decimal(20,2)").alias("balance"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank statement for each user; every seventh is told a wrong balance in the middle."""
    amount = (F.col("value").cast(MONEY) * F.when(F.col("event_type") == "purchase", -1).otherwise(1)).cast(MONEY)
    t = running_balance(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "ts", amount.alias("amount")), "event_id")
    said = (F.col("balance") + 100 + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).cast(MONEY)
    t = t.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "amount", said.alias("balance_after")))).alias("transactions"), F.sum("amount").cast(MONEY).alias("s"),
                                 F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).cast(MONEY).alias("dep"), F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0)).cast(MONEY).alias("wd"))
    u = F.col("user_id")
    return t.select(
        u.alias("doc_id"), F.lit("Bank").alias("bank_name"), F.lit("Holder").alias("account_holder"), F.lit("2024-01-01").cast("date").alias("period_start"), F.lit("2024-01-31").cast("date").alias("period_end"),
        F.lit(None).cast("string").alias("iban"), F.lit("100.00").cast(MONEY).alias("opening_balance"), (F.col("dep") + F.when(u % 5 == 0, 1).otherwise(0)).cast(MONEY).alias("total_deposits"),
        F.col("wd").alias("total_withdrawals"), (F.col("s") + 100).cast(MONEY).alias("closing_balance"), "transactions",
    )


def statement_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.issues(statements(spark, sf_dir), "bank_statement").groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.to_date("l_shipdate") < F.to_date("o_orderdate"))
    return x.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max(dates.days_apart(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).alias("most_days"))


def date_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.year("l_shipdate").alias("year"), dates.plausible(F.to_date("l_shipdate"), "1996-02-29", 1).alias("ok")).groupBy("year", "ok").agg(F.count(F.lit(1)).alias("n"))


def party_core_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core names of suppliers under twelve ways to write a legal form."""
    forms = ("", " Inc.", " S.A.", " GmbH", ", Ltd", " Co Ltd", " S.L.", "  LLC", " B.V.", " AG & Co KG", " Company, Inc", " Holding")
    n = F.concat(F.col("s_name"), F.get(F.array(*[F.lit(f) for f in forms]), (F.col("s_suppkey") % len(forms)).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", n.alias("name"), text.core_name(n).alias("core"))


def same_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = party_core_name(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    x = n.join(s.select(F.col("s_suppkey"), F.upper("s_name").alias("plain")), "s_suppkey")
    return x.select("s_suppkey", text.same_entity(F.col("name"), F.col("plain")).alias("same"))


def iban_text(key: Column) -> Column:
    body = F.lpad(key.cast("string"), 18, "0")
    rest = (98 - F.pmod((F.pmod(key, F.lit(97)) * 1000000 + 131400).cast("bigint"), F.lit(97))).cast("int")
    return F.concat(F.lit("DE"), F.lpad((rest + F.when(key % 4 == 0, 1).otherwise(0)).cast("string"), 2, "0"), F.substring(body, 1, 4), F.lit(" "), F.substring(body, 5, 14))


def iban_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IBANs made of order keys; every fourth has a wrong check number, every ninth the wrong length."""
    k = F.col("o_orderkey")
    iban = F.when(k % 9 == 0, F.concat(iban_text(k), F.lit("7"))).otherwise(iban_text(k))
    return table(spark, sf_dir, "orders").select("o_orderkey", iban.alias("iban"), checks.iban_shaped(iban).alias("shaped"), checks.iban_valid(iban).alias("valid"))


def vat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys as bodies of VAT numbers of six countries."""
    c = table(spark, sf_dir, "customer")
    b = lambda n: F.lpad(((F.col("c_custkey") * 7919 + 104729) % 10**n).cast("string"), n, "0")
    sizes = {"PT": 9, "DK": 8, "LU": 8, "PL": 10, "FI": 8, "NL": 9}
    c = c.select("c_custkey", *[b(n).alias(p) for p, n in sizes.items()], F.concat(F.lit("CZ"), b(9)).alias("CZ"))
    return c.select("c_custkey", *[checks.VAT_CHECKERS[p](F.col(p)).alias(p.lower()) for p in sizes], checks.vat_valid(F.col("CZ")).alias("cz"))


def luhn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.lpad((F.col("o_orderkey") * 7919 % 1000000000).cast("string"), 9, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.luhn(b).alias("valid"), checks.ein_valid(b).alias("ein"))


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed in four conventions, read back."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast(MONEY).alias("p")).distinct()
    us, plain = F.format_number("p", 2), F.col("p").cast("string")
    eu = F.translate(us, ",.", ".,")
    shown = F.get(F.array(us, eu, F.replace(plain, F.lit("."), F.lit(",")), F.regexp_replace(us, r"\..*", "")), (F.col("l_orderkey") % 4).cast("int"))
    return li.select("l_orderkey", "p", shown.alias("shown"), money.parse_amount(shown).cast(MONEY).alias("amount"))


def date_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The convention of a line that prints an order's dates day first, month first, with dots, or with a currency only."""
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    line = F.get(F.array(F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "dd.MM.yyyy"), F.lit("$ 12.50"), F.lit("total 12,50"), F.lit("EUR 3.10")), (F.col("o_orderkey") % 6).cast("int"))
    return o.select("o_orderkey", dates.convention(line).alias("convention"))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.with_language(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "detected", "share")


def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.with_language(table(spark, sf_dir, "documents").select("lang", "text")).groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


#: Function words as "types", so that the generic scorer has something to tell apart here.
WORD_TYPES = tuple(language.Keyword(s, rf"\b{w}\b", w_) for s, words in (("english", (("the", 3), ("and", 2), ("with", 1))), ("german", (("der", 3), ("und", 2), ("mit", 1))), ("french", (("de", 1), ("la", 1), ("des", 3))), ("spanish", (("que", 2), ("de", 1), ("la", 1), ("los", 3)))) for w, w_ in words)


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.keyword_scores(table(spark, sf_dir, "documents"), WORD_TYPES)


def keyword_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.decide(keyword_scores(spark, sf_dir))


def text_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, some with marks of an unreadable font for their spaces or for most of their letters."""
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 6 == 0, F.regexp_replace("text", "[aeinorst ]", "(cid:12)")).when(F.col("doc_id") % 6 == 3, F.replace("text", F.lit(" "), F.lit("(cid:12)"))).otherwise(F.col("text"))
    return d.select("doc_id", text.quality_ok(t).alias("ok"), F.md5(text.normalize(F.col("text"))).alias("normal_md5"))


def citation_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals cited from lines that print them whole, a unit lower, or as quantity times price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("t"))
    k = F.col("o_orderkey")
    quote = F.when(k % 4 == 0, F.concat(F.lit("Total "), F.format_number("t", 2))).when(k % 4 == 1, F.concat(F.lit("Total "), (F.col("t") - 1).cast("string"))).when(k % 4 == 2, F.concat(F.lit("2 x "), (F.col("t") * 2).cast(MONEY).cast("string"))).otherwise("no number here")
    return o.select("o_orderkey", validation.grounded(quote, F.col("t")).alias("grounded"), text.label_of(quote).alias("label"))


def vat_check_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys as bodies of VAT numbers of the other eleven countries."""
    k = F.col("c_custkey")
    b = lambda n: F.lpad(((k * 7919 + 104729) % 10**n).cast("string"), n, "0")
    letter = lambda s: F.substr(F.lit(s), (k % len(s) + 1).cast("int"), F.lit(1))
    bodies = {
        "AT": F.concat(F.lit("U"), b(8)), "BE": b(10), "CHE": b(9), "DE": b(9), "ES": F.concat(b(8), letter(checks.DNI_LETTERS)), "FR": b(11), "GB": b(9),
        "IE": F.concat(b(7), letter(checks.IE_LETTERS)), "IT": b(11), "NO": b(9), "SE": F.concat(b(10), F.lit("01")),
    }
    c = table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(p) for p, v in bodies.items()])
    return c.select("c_custkey", *[checks.VAT_CHECKERS[p](F.col(p)).alias(f"vat_{p.lower()}") for p in bodies])


def national_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys as national numbers, bare and as printed."""
    k = F.col("c_custkey")
    b = lambda n: F.lpad(((k * 7919 + 104729) % 10**n).cast("string"), n, "0")
    c = table(spark, sf_dir, "customer").select("c_custkey", b(9).alias("n9"), b(11).alias("n11"), F.lpad((k * 7919 + 104729).cast("string"), 14, "1").alias("n14"))
    bic = F.get(F.array(*[F.lit(x) for x in ("COBADEFF", "cobadeffxxx", "COBADEFFX", "C0BADEFF")]), (k % 4).cast("int"))
    printed = F.when(k % 2 == 0, F.concat(F.substring("n9", 1, 2), F.lit("-"), F.substring("n9", 3, 7))).otherwise(F.col("n9"))
    t = checks.tax_id(printed)
    return c.select(
        "c_custkey", checks.ca_bn_valid(F.concat("n9", F.lit("RC0001"))).alias("bn"), checks.cpf_valid(F.col("n11")).alias("cpf"), checks.cnpj_valid(F.col("n14")).alias("cnpj"),
        checks.bic_valid(bic).alias("bic"), t["valid"].alias("tax_valid"), t["scheme"].alias("tax_scheme"),
    )


def by_rule(docs: DataFrame, schema: str, only: tuple[str, ...] = ()) -> DataFrame:
    return validation.issues(docs, schema, validation.Context(as_of=AS_OF), only=only).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def off_by(every: int, amount: str) -> Column:
    """``amount`` for the orders whose key the number divides, else 0."""
    return F.when(F.col("k") % every == 0, F.lit(amount)).otherwise(F.lit("0")).cast(MONEY)


def keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = (F.col("o_totalprice") / 10).cast(MONEY)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day"), price.alias("p"))
    return o.withColumn("line", (2 * F.col("p") + off_by(5, "0.05")).cast(MONEY))


def receipt_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = keyed_orders(spark, sf_dir)
    item = lambda q, p, t: F.struct(F.lit(q).cast(MONEY).alias("quantity"), p.alias("unit_price"), t.alias("price"))
    one = F.lit("1.00").cast(MONEY)
    o = o.withColumn("subtotal", (F.col("line") + 1 + off_by(7, "0.03")).cast(MONEY)).withColumn("total_amount", (F.col("subtotal") + off_by(11, "1.00")).cast(MONEY))
    docs = o.select(
        "doc_id", F.array(item(2, F.col("p"), F.col("line")), item(1, one, one)).alias("items"), "subtotal", F.lit(0).cast(MONEY).alias("tax_amount"), F.lit(None).cast(MONEY).alias("discount_amount"),
        F.lit(None).cast(MONEY).alias("tip_amount"), "total_amount", (F.col("total_amount") + 10).cast(MONEY).alias("amount_tendered"), (10 + off_by(13, "0.10")).cast(MONEY).alias("change_given"),
        F.when(F.col("k") % 17 == 0, "DK13585627").when(F.col("k") % 17 == 1, "DK13585628").otherwise("").alias("merchant_tax_id"), F.lit("DK").alias("country_code"),
    )
    return by_rule(docs, "receipt")


def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = keyed_orders(spark, sf_dir), F.col("k")
    o = o.withColumn("subtotal", (F.col("line") + off_by(7, "0.02")).cast(MONEY))
    none = F.array().cast("array<struct<value:string,scheme:string,country_code:string>>")
    docs = o.select(
        "doc_id", F.when(k % 101 == 0, " ").otherwise(k.cast("string")).alias("number"), F.concat(F.lit("Seller "), k % 7, F.lit(" GmbH")).alias("seller"),
        F.when(k % 19 == 0, F.concat(F.lit("seller "), k % 7)).otherwise(F.concat(F.lit("Buyer "), k)).alias("buyer"), F.col("day").alias("po_date"), "subtotal", F.lit("1.00").cast(MONEY).alias("tax_amount"),
        (F.col("subtotal") + 1 + off_by(9, "1.00")).cast(MONEY).alias("total_amount"), none.alias("seller_tax_ids"), none.alias("buyer_tax_ids"),
        F.array(F.struct(F.lit(2).cast(MONEY).alias("quantity"), F.col("p").alias("unit_price"), F.col("line").alias("total"))).alias("line_items"),
    )
    return by_rule(docs, "purchase_order")


def waybill_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = keyed_orders(spark, sf_dir), F.col("k")
    item = lambda q, w, p, t: F.struct(F.lit(q).cast(MONEY).alias("quantity"), F.lit(w).cast(MONEY).alias("gross_weight_kg"), p.alias("unit_price"), t.alias("total_price"))
    two = F.lit("2.00").cast(MONEY)
    docs = o.select(
        "doc_id", k.cast("string").alias("number"), F.concat(F.lit("Ship "), k % 5).alias("shipper"), F.when(k % 19 == 0, F.concat(F.lit("SHIP "), k % 5, F.lit(" Ltd"))).otherwise(F.concat(F.lit("Consignee "), k)).alias("consignee"),
        F.col("day").alias("waybill_date"), F.array(item(2, "1.50", F.col("p"), F.col("line")), item(1, "2.50", two, two)).alias("items"), (3 + off_by(7, "1.00")).cast(MONEY).alias("total_quantity"),
        (4 + off_by(11, "0.10")).cast(MONEY).alias("total_gross_weight_kg"), (F.col("line") + 2 + off_by(13, "1.00")).cast(MONEY).alias("total_amount"),
    )
    return by_rule(docs, "waybill")


def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = keyed_orders(spark, sf_dir), F.col("k")
    a = F.concat(F.lit("Alpha "), k % 5, F.lit(" GmbH"))
    b = F.when(k % 7 == 0, F.concat(F.lit("ALPHA "), k % 5)).when(k % 7 == 1, F.concat(F.lit("Alpha "), k % 5, F.lit(" Holding"))).when(k % 7 == 2, "").otherwise(F.concat(F.lit("Beta "), k))
    day = F.col("day")
    dated = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "dd.MM.yyyy")).when(k % 4 == 2, F.date_format(day, "d MMMM yyyy")).otherwise("in spring")
    text_ = F.when(k % 3 != 0, F.concat(F.lit("Agreement of "), a, F.lit(" and "), F.when(k % 29 == 0, "nobody").otherwise(b), F.lit(", dated "), dated))
    docs = o.select(
        "doc_id", F.array(a).alias("parties_a"), F.array(b).alias("parties_b"), F.col("day").alias("effective_date"), F.date_add("day", F.when(k % 11 == 0, -1).otherwise(365)).alias("expiration_date"),
        F.when(k % 13 == 0, F.lit(-1)).when(k % 13 != 1, F.col("p")).cast(MONEY).alias("contract_value"), F.when(k % 17 != 0, "EUR").alias("currency"),
        F.when(k % 19 == 0, -1).when(k % 19 == 1, 400).otherwise(30).alias("notice_period_days"), F.when(k % 23 == 0, -1).when(k % 23 == 1, 200).otherwise(30).alias("cure_period_days"), text_.alias("raw_text"),
    )
    return by_rule(docs, "contract")


QUERIES = {f.__name__: f for f in (
    invoice_issues, line_sum_vs_total, line_arithmetic, rate_vs_tax, running_balance, statement_issues, date_order, date_plausible, party_core_name, same_entity,
    iban_check, vat_check, luhn_check, amount_parse, date_convention, language_detect, language_confusion, keyword_scores, keyword_margin, text_quality_gate, citation_grounding,
    vat_check_more, national_ids, receipt_issues, order_issues, waybill_issues, contract_issues,
)}

CORE = """with n as (select s_suppkey, s_name, s_name || (['', ' Inc.', ' S.A.', ' GmbH', ', Ltd', ' Co Ltd', ' S.L.', '  LLC', ' B.V.', ' AG & Co KG', ' Company, Inc', ' Holding'])[(s_suppkey % 12) + 1] as name from supplier),
m as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) x from n),
g as (select *, regexp_replace(x, '(^| )([a-z0-9]) ([a-z0-9])$', '\\1\\2\\3') y from m),
c as (select *, trim(regexp_replace(y, '((^| )(inc|incorporated|corp|corporation|company|co|ltd|limited|llc|llp|lp|plc|sa|sau|sl|slu|sca|gmbh|mbh|bv|nv|ag|as|oy|ab|pte|pty|srl|spa|sarl|kg|ou))+$', '')) core from g)
"""
INV = """
with li as (select l_orderkey id, cast(l_quantity as decimal(18,2)) q, cast(round(cast(l_extendedprice as decimal(18,2)) / 10, 2) as decimal(18,2)) p, l_returnflag f, cast(l_shipdate as date) d from lineitem),
l2 as (select *, cast(q * p + case f when 'R' then 0.02 when 'A' then 0.01 else 0 end as decimal(18,2)) t from li)
"""
EV = "(select event_id, user_id, ts, cast(cast(value as decimal(18,2)) * case when event_type = 'purchase' then -1 else 1 end as decimal(18,2)) amount from events)"
HITS = """with w as (select doc_id, lang, list_transform(regexp_extract_all(text, '[a-záéíóúüñçàèòïA-ZÁÉÍÓÚÜÑÇÀÈÒÏ]+'), lambda x: lower(x)) w from documents),
h as (select doc_id, lang, len(list_filter(w, lambda x: x in ('the','and','of','to','in','for','is','are','be','with','this','that','shall','from','by','on','as','at','or','an'))) en,
 len(list_filter(w, lambda x: x in ('de','la','el','los','las','y','en','que','por','con','del','para','se','un','una','al','es','son','su','lo'))) es from w),
r as (select doc_id, lang, case when en + es = 0 then 'unknown' when en >= es then 'en' else 'es' end detected,
 cast(case when en + es = 0 then 0 else round(cast(greatest(en, es) * 100000000 // (en + es) as decimal(18,0)) / 100000000.0, 2) end as decimal(4,2)) share from h)
"""
KEYS = "with s as (select * from (" + " union all ".join(
    f"select doc_id, '{t}' schema, " + " + ".join(f"case when regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){k.pattern[2:-2]}($|[^\\p{{L}}\\p{{N}}_])') then {k.weight}.0::double else 0 end" for k in WORD_TYPES if k.schema == t) + " score from documents"
    for t in sorted({k.schema for k in WORD_TYPES})
) + ") where score > 0)"


def counted(*rules: tuple[str, str, str]) -> str:
    """How many orders k have each (rule, severity) under its condition; rules of one name and severity add up."""
    each = " union all ".join(f"select '{r}' rule, '{v}' severity from o where {c}" for r, v, c in rules)
    return f"with o as (select o_orderkey k, cast(o_orderdate as date) d from orders), i as ({each}) select rule, severity, count(*) n from i group by 1, 2"


def digits(s: str, n: int) -> str:
    return f"list_transform(range(1, {n + 1}), lambda i: cast({s}[i] as int))"


def dot(x: str, *weights: int) -> str:
    return "(" + " + ".join(f"{x}[{i}] * {w}" for i, w in enumerate(weights, 1)) + ")"


def luhn_sql(x: str, n: int) -> str:
    return "((" + " + ".join(f"({x}[{i}] * 2 // 10 + {x}[{i}] * 2 % 10)" if (n - i) % 2 else f"{x}[{i}]" for i in range(1, n + 1)) + ") % 10 = 0)"


def below_two(x: str) -> str:
    return f"case when {x} % 11 < 2 then 0 else 11 - {x} % 11 end"


def crossed(x: str, *at: int) -> str:
    return "(" + " + ".join(f"({x}[{i}] * 2 // 10 + {x}[{i}] * 2 % 10)" for i in at) + ")"


def of_eleven(x: str, check: str) -> str:
    return f"case 11 - {x} % 11 when 10 then false when 11 then {check} = 0 else 11 - {x} % 11 = {check} end"


BODIES = f"""with v as (select c_custkey k, c_custkey * 7919 + 104729 v from customer),
s as (select k, v, {', '.join(f"lpad(cast(v % {10**n} as varchar), {n}, '0') s{n}" for n in (7, 8, 9, 10, 11))}, lpad(cast(v as varchar), 14, '1') s14 from v),
d as (select *, {', '.join(f"{digits(f's{n}', n)} d{n}" for n in (7, 8, 9, 10, 11, 14))} from s)
"""
ORACLE = {
    "vat_check_more": BODIES + f"""select k c_custkey, (10 - (d8[1] + d8[3] + d8[5] + d8[7] + {crossed('d8', 2, 4, 6)} + 4) % 10) % 10 = d8[8] vat_at,
 d10[1] < 2 and 97 - cast(s10[1:8] as int) % 97 = cast(s10[9:10] as int) vat_be, {of_eleven(dot('d9', 5, 4, 3, 2, 7, 6, 5, 4), 'd9[9]')} vat_che,
 (11 - list_reduce(list_prepend(10, d9[1:8]), lambda p, x: (2 * ((x + p + 9) % 10 + 1)) % 11)) % 10 = d9[9] vat_de,
 ('{checks.DNI_LETTERS}')[cast(s8 as int) % 23 + 1] = ('{checks.DNI_LETTERS}')[k % 23 + 1] vat_es, cast(s11[1:2] as int) = (12 + 3 * (cast(s11[3:11] as bigint) % 97)) % 97 vat_fr,
 (({dot('d9', 8, 7, 6, 5, 4, 3, 2)} + cast(s9[8:9] as int)) % 97) in (0, 55) vat_gb, ('{checks.IE_LETTERS}')[{dot('d7', 8, 7, 6, 5, 4, 3, 2)} % 23 + 1] = ('{checks.IE_LETTERS}')[k % 23 + 1] vat_ie,
 (10 - (d11[1] + d11[3] + d11[5] + d11[7] + d11[9] + {crossed('d11', 2, 4, 6, 8, 10)}) % 10) % 10 = d11[11] vat_it, {of_eleven(dot('d9', 3, 2, 7, 6, 5, 4, 3, 2), 'd9[9]')} vat_no, {luhn_sql('d10', 10)} vat_se from d""",
    "national_ids": BODIES + f"""select k c_custkey, {luhn_sql('d9', 9)} bn,
 len(list_distinct(d11)) > 1 and {below_two(dot('d11', *range(10, 1, -1)))} = d11[10] and {below_two(dot('d11', *range(11, 1, -1)))} = d11[11] cpf,
 len(list_distinct(d14)) > 1 and {below_two(dot('d14', 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))} = d14[13] and {below_two(dot('d14', 6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))} = d14[14] cnpj,
 k % 4 in (0, 1) bic, case when k % 2 = 0 then cast(s9[1:2] as int) not in (0, {', '.join(map(str, checks.EIN_UNUSED))}) end tax_valid, case when k % 2 = 0 then 'US EIN' end tax_scheme from d""",
    "receipt_issues": counted(("receipt_lines", "error", "k % 5 = 0"), ("receipt_items_sum", "error", "k % 7 = 0"), ("receipt_total", "error", "k % 11 = 0"), ("receipt_tender", "error", "k % 13 = 0"), ("receipt_tax_id", "error", "k % 17 = 0")),
    "order_issues": counted(("order_names", "error", "k % 101 = 0"), ("order_names", "error", "k % 19 = 0"), ("order_lines", "error", "k % 5 = 0"), ("order_lines_sum", "error", "k % 7 = 0"), ("order_total", "error", "k % 9 = 0"),
                            ("po_date_range", "error", "d > date '1999-06-01' or d < date '1990-01-01'")),
    "waybill_issues": counted(("waybill_names", "error", "k % 19 = 0"), ("waybill_prices", "error", "k % 5 = 0"), ("waybill_sums", "error", "k % 7 = 0"), ("waybill_sums", "error", "k % 11 = 0"), ("waybill_sums", "error", "k % 13 = 0"),
                              ("waybill_date_range", "error", "d > date '1999-06-01' or d < date '1990-01-01'")),
    "contract_issues": counted(
        ("party_missing", "error", "k % 7 = 2"), ("same_party", "error", "k % 7 = 0"), ("related_party", "warning", "k % 7 = 1"), ("expires_before_start", "error", "k % 11 = 0"),
        ("contract_amounts", "error", "k % 13 = 0"), ("contract_amounts", "warning", "k % 13 > 1 and k % 17 = 0"), ("contract_amounts", "warning", "k % 13 = 1 and k % 17 <> 0"),
        ("contract_periods", "error", "k % 19 = 0"), ("contract_periods", "warning", "k % 19 = 1"), ("contract_periods", "error", "k % 23 = 0"), ("contract_periods", "warning", "k % 23 = 1"),
        ("parties_in_text", "error", "k % 3 <> 0 and ((k % 29 = 0 and k % 7 <> 0) or k % 7 = 2)"),
        ("dates_in_text", "warning", "k % 3 <> 0 and k % 4 = 3"), ("dates_in_text", "warning", "k % 3 <> 0"),
    ),
    "line_sum_vs_total": """with s as (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(20,2)) line_sum, count(*) n from lineitem group by 1)
select o_orderkey, cast(o_totalprice as decimal(18,2)) total, line_sum, coalesce(n, 0) n_lines, coalesce(abs(line_sum - cast(o_totalprice as decimal(18,2))) <= 0.01, false) agrees from orders left join s on o_orderkey = l_orderkey""",
    "line_arithmetic": """with x as (select l_orderkey, l_partkey, l_linenumber, cast(l_quantity as decimal(18,2)) q, cast(p_retailprice as decimal(18,2)) p, cast(l_extendedprice as decimal(18,2)) e, cast(l_discount as decimal(6,2)) d
 from lineitem join part on l_partkey = p_partkey)
select l_orderkey, l_partkey, l_linenumber, abs(q * p - e) <= 0.01 or abs(q * p - e) <= q * 0.005 or (d > 0 and d < 1 and abs(q * p * (1 - d) - e) <= 0.01) explained, cast(abs(q * p - e) as decimal(18,2)) off from x""",
    "rate_vs_tax": """with x as (select l_returnflag, cast(l_extendedprice as decimal(18,2)) e, cast(l_tax as decimal(6,2)) r, cast(l_discount as decimal(6,2)) d from lineitem)
select l_returnflag, count(*) n, count(*) filter (abs(round(e * r, 2) - round(e * d, 2)) > 0.05) off from x group by 1""",
    "running_balance": f"select event_id, user_id, cast(sum(amount) over (partition by user_id order by ts, event_id rows unbounded preceding) as decimal(20,2)) balance from {EV}",
    "statement_issues": f"""with e as {EV}, s as (select user_id, sum(case when amount > 0 then amount else 0 end) dep, count(*) filter (event_id % 97 = 0) w from e group by 1)
select user_id doc_id, 'balance_equation' rule, cast(1 as bigint) n from s where user_id % 5 = 0 union all select user_id, 'movement_sums', 1 from s where user_id % 5 = 0 union all select user_id, 'running_balance', w from s where w > 0""",
    "date_order": """select o_orderpriority, count(*) n, max(date_diff('day', cast(l_shipdate as date), cast(o_orderdate as date)))::int most_days from lineitem join orders on l_orderkey = o_orderkey
where cast(l_shipdate as date) < cast(o_orderdate as date) group by 1""",
    "date_plausible": "select cast(year(l_shipdate) as int) as year, cast(l_shipdate as date) between date '1990-01-01' and date '1997-02-28' ok, count(*) n from lineitem group by 1, 2",
    "party_core_name": CORE + "select s_suppkey, name, core from c",
    "same_entity": CORE + "select s_suppkey, core <> '' and core = trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) same from c",
    "iban_check": """with k as (select o_orderkey k, lpad(cast(o_orderkey as varchar), 18, '0') body, 98 - ((o_orderkey % 97) * 1000000 + 131400) % 97 r from orders),
i as (select k, 'DE' || lpad(cast(r + case when k % 4 = 0 then 1 else 0 end as varchar), 2, '0') || substr(body, 1, 4) || ' ' || substr(body, 5, 14) || case when k % 9 = 0 then '7' else '' end iban from k)
select k o_orderkey, iban, true shaped, k % 9 <> 0 and cast(substr(replace(iban, ' ', ''), 5) || '1314' || substr(iban, 3, 2) as hugeint) % 97 = 1 valid from i""",
    "luhn_check": """with b as (select o_orderkey, lpad(cast(o_orderkey * 7919 % 1000000000 as varchar), 9, '0') s from orders),
d as (select o_orderkey, s, list_transform(range(1, 10), lambda i: case when i % 2 = 0 then case when cast(s[i] as int) * 2 > 9 then cast(s[i] as int) * 2 - 9 else cast(s[i] as int) * 2 end else cast(s[i] as int) end) x from b)
select o_orderkey, list_sum(x) % 10 = 0 valid, cast(s[1:2] as int) not in (0, 7, 8, 9, 17, 18, 19, 28, 29, 49, 69, 70, 78, 79, 89) ein from d""",
    "vat_check": """with b as (select c_custkey k, c_custkey * 7919 + 104729 v from customer),
d as (select k, lpad(cast(v % 100000000 as varchar), 8, '0') s8, lpad(cast(v % 1000000000 as varchar), 9, '0') s9, lpad(cast(v % 10000000000 as varchar), 10, '0') s10 from b),
w as (select k, s8, s9, s10,
 list_sum(list_transform(range(1, 9), lambda i: cast(s9[i] as int) * (10 - i))) % 11 p9,
 list_sum(list_transform(range(1, 9), lambda i: cast(s8[i] as int) * ([2,7,6,5,4,3,2,1])[i])) % 11 dk,
 list_sum(list_transform(range(1, 10), lambda i: cast(s10[i] as int) * ([6,5,7,2,3,4,5,6,7])[i])) % 11 pl,
 list_sum(list_transform(range(1, 8), lambda i: cast(s8[i] as int) * ([7,9,10,5,8,4,2])[i])) % 11 fi from d)
select k c_custkey, case when p9 < 2 then 0 else 11 - p9 end = cast(s9[9] as int) pt, dk = 0 dk, cast(s8[1:6] as int) % 89 = cast(s8[7:8] as int) lu, pl <> 10 and pl = cast(s10[10] as int) pl,
 fi <> 1 and case when fi = 0 then 0 else 11 - fi end = cast(s8[8] as int) fi, case when p9 = 10 then 0 else p9 end = cast(s9[9] as int) nl, cast(null as boolean) cz from w""",
    "amount_parse": """with l as (select distinct l_orderkey, cast(l_extendedprice as decimal(18,2)) p from lineitem),
s as (select *, format('{:,.2f}', cast(p as double)) us from l)
select l_orderkey, p, case l_orderkey % 4 when 0 then us when 1 then translate(us, ',.', '.,') when 2 then replace(cast(p as varchar), '.', ',') else split_part(us, '.', 1) end shown,
 cast(case when l_orderkey % 4 = 3 then floor(p) else p end as decimal(18,2)) amount from s""",
    "date_convention": """with d as (select o_orderkey, o_orderkey % 6 m, day(o_orderdate) d, month(o_orderdate) mo from orders)
select o_orderkey, case m when 0 then case when d > 12 then 'dmy' end when 1 then case when d > 12 then 'mdy' end when 2 then 'dmy' when 3 then 'mdy' when 4 then 'dmy' else 'dmy' end convention from d""",
    "language_detect": HITS + "select doc_id, detected, share from r",
    "language_confusion": HITS + "select lang, detected, count(*) n from r group by 1, 2",
    "invoice_issues": INV + """, o as (select o_orderkey k, o_custkey c, cast(o_orderdate as date) d from orders),
s as (select id, sum(t) s0, min(d) due, count(*) filter (f = 'R' and q < 4) bad from l2 group by 1),
x as (select k, c, d, due, bad, s0, s0 + case k % 7 when 0 then 0.02 when 1 then 0.01 else 0 end sub, case when k % 2 = 0 then 10 else 20 end rate, round(s0 / 10, 2) tax from o join s on k = id),
i as (select k, 'number_empty' rule, 'error' severity, 1 n from x where k % 101 = 0
 union all select k, 'due_before_issue', 'error', 1 from x where due < d
 union all select k, 'seller_is_buyer', 'warning', 1 from x where c % 5 = k % 5
 union all select k, 'rate_times_subtotal', 'warning', 1 from x where sub > 0 and abs(tax - round(sub * rate / 100, 2)) > 0.05
 union all select k, 'line_arithmetic', 'error', bad from x where bad > 0
 union all select k, 'lines_sum_to_subtotal', 'error', 1 from x where k % 7 = 0
 union all select k, 'total_equation', 'error', 1 from x where k % 7 = 0 or k % 9 = 0
 union all select k, 'issue_date_range', 'error', 1 from x where d > date '1999-06-01' or d < date '1990-01-01'
 union all select k, 'iban_checksum', 'error', 1 from x where k % 13 = 0 and k % 4 = 0
 union all select k, 'iban_not_used', 'error', 1 from x where k % 13 = 1 union all select k, 'iban_shape', 'error', 1 from x where k % 13 = 2
 union all select k, 'bic_shape', 'warning', 1 from x where k % 17 = 0 union all select k, 'seller_tax_ids', case when k % 19 = 0 then 'error' else 'warning' end, 1 from x where k % 19 in (0, 2)
 union all select k, 'buyer_tax_ids', 'error', 1 from x where k % 23 = 1
 union all select k, 'due_date_range', 'error', 1 from x where due > date '2008-06-01' or due < date '1990-01-01')
select rule, severity, cast(sum(n) as bigint) n, count(distinct k) docs from i group by 1, 2""",
    "keyword_scores": KEYS + "select doc_id, schema, score from s",
    "keyword_margin": KEYS + """, r as (select *, row_number() over (partition by doc_id order by score desc, schema) k, sum(score) over (partition by doc_id) total, lead(score) over (partition by doc_id order by score desc, schema) nxt from s)
select doc_id, schema doc_type, cast(round(cast(score as int) * 100000000 // cast(total as int) / 100000000.0, 2) as decimal(4,2)) confidence from r where k = 1 and score - coalesce(nxt, 0) >= 2""",
    "text_quality_gate": """with t as (select doc_id, text, trim(case doc_id % 6 when 0 then regexp_replace(text, '[aeinorst ]', '(cid:12)', 'g') when 3 then replace(text, ' ', '(cid:12)') else text end) x from documents)
select doc_id, length(coalesce(x, '')) >= 20 and len(regexp_extract_all(coalesce(x, ''), '\\(cid:[0-9]+\\)')) <= 0.1 * length(coalesce(x, '')) ok, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) normal_md5 from t""",
    "citation_grounding": "select o_orderkey, o_orderkey % 4 in (0, 2) grounded, (['total', 'total', 'x', 'no number here'])[o_orderkey % 4 + 1] as label from orders",
}
