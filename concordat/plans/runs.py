"""Queries of citations, runs and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.operators import citations, metrics, mutations, runs, validation
from concordat.plans.analytics import ratio
from concordat.session import spread, table

MONEY = "decimal(18,2)"


def cited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's date, number and customer cited from lines that print them, print others, or print none."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), k.alias("k"), d.alias("day"))


def citation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("k"), F.col("day")
    quote = (
        F.when(k % 6 == 0, F.concat(F.lit("Date: "), F.date_format(d, "yyyy-MM-dd"))).when(k % 6 == 1, F.concat(F.lit("due "), F.date_format(F.date_add(d, 1), "yyyy-MM-dd"))).when(k % 6 == 2, "no date here")
        .when(k % 6 == 3, F.date_format(d, "dd/MM/yyyy")).when(k % 6 == 4, F.date_format(d, "MM/dd/yyyy")).otherwise(" ")
    )
    c = cited_orders(spark, sf_dir).select("doc_id", F.lit("issue_date").alias("field"), "day", quote.alias("quote"), F.lit("printed 25/12/2001").alias("page_text"))
    return citations.cited_dates(c)


def citation_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    quote = F.when(k % 4 == 0, F.concat(F.lit("No. INV "), k, F.lit("/7"))).when(k % 4 == 1, F.concat(F.lit("inv-"), k + 1, F.lit("-7"))).when(k % 4 == 2, "")
    value = F.when(k % 9 == 0, "--").otherwise(F.concat(F.lit("INV-"), k, F.lit("-7")))
    c = cited_orders(spark, sf_dir).select("doc_id", F.when(k % 5 == 0, "buyer.name").otherwise("invoice_number").alias("field"), value.alias("value"), quote.alias("quote"))
    return citations.cited_identifiers(c)


def citation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    quote = F.when(k % 4 == 0, "ACME Trading, S.L. - Madrid").when(k % 4 == 1, "Acme Tradnig").when(k % 4 == 2, "Total 12.50").otherwise("")
    field = F.when(k % 3 == 0, "seller.name").when(k % 3 == 1, "buyer.contact_name").otherwise("parties_a[0]")
    return citations.cited_names(cited_orders(spark, sf_dir).select("doc_id", field.alias("field"), F.lit("Acme Trading GmbH").alias("value"), quote.alias("quote")))


def unconfirmed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    docs = cited_orders(spark, sf_dir).select("doc_id", (k % 2 == 0).alias("read_by_model"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("confident_reading"))
    return citations.unconfirmed_readings(docs)


def value_citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals on the first of three lines that prints their most specific form: one line has one of five forms, one the first or the second."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast(MONEY).alias("t"))
    forms = citations.amount_renderings(F.col("t"))
    k = F.col("doc_id")
    shown, other = F.get(forms, (k % 5).cast("int")), F.get(forms, (k % 2).cast("int"))
    lines = o.select("doc_id", F.posexplode(F.array(F.lit("Invoice"), F.concat(F.lit(" Sum "), shown), F.when(k % 7 != 0, F.concat(F.lit("Total "), other)))).alias("line_no", "line"))
    return citations.cited_line(lines, o.select("doc_id", F.lit("total").alias("field"), forms.alias("forms"))).select("doc_id", "line_no", "line")


def cited_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices with a page that prints them; dates in two ways, some pages with another date that tells the order of day and month."""
    k, d, t = F.col("o_orderkey"), F.to_date("o_orderdate"), F.col("o_totalprice").cast(MONEY)
    s = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    none = lambda kind: F.lit(None).cast(kind)
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey").select(
        k.alias("doc_id"), s("INV-", k).alias("number"), d.alias("issue_date"), F.lit("Hafen Kontor GmbH").alias("seller"), F.lit("Buyer Ltd").alias("buyer"),
        F.when(k % 3 != 1, "DE89 3704 0044 0532 0130 00").alias("iban"), t.alias("subtotal"), F.lit("5.00").cast(MONEY).alias("tax_amount"), (t + 5).cast(MONEY).alias("total_amount"),
    )
    number, total, sub = F.col("number"), F.col("total_amount"), F.col("subtotal")
    day = F.when(F.col("doc_id") % 2 == 0, F.date_format("issue_date", "yyyy-MM-dd")).otherwise(F.date_format("issue_date", "dd/MM/yyyy"))
    quotes = {"invoice_number": s("Invoice ", number), "issue_date": s("Date ", day), "seller.name": F.lit("Hafen Kontor GmbH, Kiel"), "subtotal": s("Net ", sub), "tax_amount": F.lit("Tax 5.00"), "total_amount": s("Total ", total)}
    page = F.concat_ws("\n", *quotes.values(), F.when(F.col("doc_id") % 3 == 0, "Delivered 25/12/1995"))
    ids = F.array().cast("array<struct<value:string,scheme:string,country_code:string>>")
    lines = F.array().cast("array<struct<quantity:decimal(18,2),unit_price:decimal(18,2),total:decimal(18,2),tax_rate_percent:decimal(6,2),discounts:array<decimal(28,6)>>>")
    return o.select(
        "*", F.create_map(*[x for f, q in quotes.items() for x in (F.lit(f), q)]).alias("quotes"), page.alias("page_text"), none("date").alias("due_date"), none("string").alias("bic"), none("decimal(6,2)").alias("tax_rate_percent"),
        none(MONEY).alias("shipping_amount"), none(MONEY).alias("discount_amount"), F.array().cast("array<decimal(28,6)>").alias("page_rates"), lines.alias("line_items"), ids.alias("seller_tax_ids"), ids.alias("buyer_tax_ids"),
    )


def planted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight kinds of planted errors, and how many of each the library's rules tell."""
    found = mutations.caught(cited_invoices(spark, sf_dir), validation.Context(as_of="2002-01-01"))
    return metrics.catch_rate(found)


def planted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules tell which kind."""
    found = mutations.caught(cited_invoices(spark, sf_dir), validation.Context(as_of="2002-01-01"))
    # Not ``explode``: the filter that Spark infers from it would run all rules again.
    return found.select("mutation", F.explode_outer("rules").alias("rule")).where("rule is not null").groupBy("mutation", "rule").agg(F.count(F.lit(1)).alias("n"))


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and amounts as labels write them."""
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate")
    us = F.format_number(F.col("o_totalprice").cast(MONEY), 2)
    amount = F.when(k % 4 == 0, us).when(k % 4 == 1, F.translate(us, ",.", ".,")).when(k % 4 == 2, "1.234").otherwise(" 12,5 ")
    day = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "dd/MM/yy")).when(k % 4 == 2, F.date_format(d, "dd.MM.yyyy")).otherwise("2019-02-2")
    return o.select("o_orderkey", citations.label_amount(amount).cast(MONEY).alias("amount"), citations.label_date(day).alias("day"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the graded documents of a run."""
    k = F.col("o_orderkey")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("fields_total"), F.count_if(F.col("l_returnflag") == "N").alias("fields_correct"), F.count_if(F.col("l_linestatus") == "O").alias("model_pages"), F.max("l_linenumber").cast("long").alias("model_calls"),
    )
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(
        (k % 3 != 0).alias("success"), F.when(k % 10 == 0, "failed").when(k % 6 == 0, "needs_review").otherwise("succeeded").alias("status"), ((k % 10 == 0) | (k % 6 == 0) | (k % 7 == 0)).alias("needs_review"),
        "fields_correct", "fields_total", (F.col("o_totalprice").cast(MONEY) / 1000).cast("decimal(18,4)").alias("seconds"), F.col("fields_total").alias("pages"), "model_pages", "model_calls",
        F.when(k % 4 == 0, F.col("o_orderpriority")).alias("template_id"), F.col("o_orderpriority").alias("source"), F.when(k % 13 == 0, "timeout").alias("error"), F.when(k % 5 == 0, k % 2 == 0).alias("template_matched"),
        F.concat(F.lit("job"), F.col("o_custkey") % 20).alias("job"),
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_summary(graded(spark, sf_dir))


def templates_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.templates_used(graded(spark, sf_dir))


def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.replay_summary(graded(spark, sf_dir))


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.job_counts(graded(spark, sf_dir))


def competitor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = graded(spark, sf_dir).withColumns({"correct": F.col("fields_correct"), "total": F.col("fields_total")})
    return runs.competitor_summary(x)


def item_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each place of an order's lines has, and their sum."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("l_tax").cast("decimal(6,2)").alias("tax")))).alias("line_items")
    )
    x = runs.item_numbers(li, "line_items", ("quantity", "tax"))
    return x.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("decimal(20,2)").alias("total"))


QUERIES = {f.__name__: f for f in (
    citation_dates, citation_identifiers, citation_names, unconfirmed_readings, value_citing, planted_errors, planted_rules, label_values, run_summary, templates_used, replay_summary, job_counts, competitor_summary, item_numbers,
)}

GRADED = """with li as (select l_orderkey, count(*) n, count(*) filter (l_returnflag = 'N') c, count(*) filter (l_linestatus = 'O') m, max(l_linenumber) calls from lineitem group by 1),
g as (select o_orderkey k, o_orderkey % 3 <> 0 ok, case when o_orderkey % 10 = 0 then 'failed' when o_orderkey % 6 = 0 then 'needs_review' else 'succeeded' end st, o_orderkey % 10 = 0 or o_orderkey % 6 = 0 or o_orderkey % 7 = 0 rev, n, c, m, calls,
 cast(cast(round(cast(o_totalprice as decimal(18,2)) * 10, 0) as bigint) as hugeint) ms, case when o_orderkey % 4 = 0 then o_orderpriority end tpl, o_orderpriority src, o_orderkey % 13 = 0 err, case when o_orderkey % 5 = 0 then o_orderkey % 2 = 0 end tm, 'job' || (o_custkey % 20) job
 from orders join li on l_orderkey = o_orderkey)
"""
#: Invoices with each kind of error that applies, and the rules that the page and the arithmetic give against it.
MUTATED = """with o as (select o_orderkey k, cast(o_orderdate as date) d, cast(o_totalprice as decimal(18,2)) t from orders),
x as (select k, 'digit_in_total' m, ['number_printed', 'total_equation'] rules from o
 union all select k, 'consistent_inflation', ['number_printed'] from o union all select k, 'tax_off', ['number_printed', 'total_equation'] from o
 union all select k, 'day_month_swap', case when k % 2 = 0 or k % 3 = 0 then ['date_printed'] else [] end from o where day(d) <= 12 and day(d) <> month(d)
 union all select k, 'wrong_doc_number', ['identifier_printed'] from o union all select k, 'fabricated_quote', ['quote_on_page', 'total_equation'] from o
 union all select k, 'wrong_party', ['name_printed'] from o union all select k, 'broken_iban', ['iban_checksum'] from o where k % 3 <> 1)
"""
MEAN = "cast(((sum(ms) * 2 + count(*)) // (2 * count(*))) / 10000.0 as decimal(18,4))"
ORACLE = {
    "citation_dates": """with o as (select o_orderkey k, cast(o_orderdate as date) d from orders) select k doc_id, 'issue_date' field, 'error' severity from o
where k % 6 in (1, 2) or (k % 6 = 4 and day(d) <> month(d))""",
    "citation_identifiers": "select o_orderkey doc_id, 'invoice_number' field, 'error' severity from orders where o_orderkey % 5 <> 0 and (o_orderkey % 9 = 0 or o_orderkey % 4 = 1)",
    "citation_names": "select o_orderkey doc_id, case o_orderkey % 3 when 0 then 'seller.name' else 'parties_a[0]' end field, 'error' severity from orders where o_orderkey % 3 <> 1 and o_orderkey % 4 = 2",
    "unconfirmed_readings": "select o_orderkey doc_id, '*' field, 'warning' severity from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0",
    "value_citing": """with o as (select o_orderkey k, cast(o_totalprice as decimal(18,2)) t from orders), f as (select k, t, format('{:,.2f}', t::double) us, printf('%.2f', t::double) p from o),
g as (select k, t, list_filter(list_distinct([us, p, translate(us, ',.', ' ,'), translate(us, ',.', '.,'), replace(p, '.', ','), case when t = floor(t) then cast(cast(t as bigint) as varchar) end]), lambda x: x is not null) forms, [us, p, translate(us, ',.', ' ,'), translate(us, ',.', '.,'), replace(p, '.', ','), case when t = floor(t) then cast(cast(t as bigint) as varchar) end] raw from f),
r as (select k, list_filter(raw, lambda x, i: x is not null and not list_contains(raw[1:i-1], x)) forms from g),
l as (select k, forms, 1 n, ' Sum ' || forms[k % 5 + 1] line from r union all select k, forms, 2, 'Total ' || forms[k % 2 + 1] from r where k % 7 <> 0),
h as (select k, n, line, list_position(list_transform(forms, lambda x: contains(line, x)), true) rank from l where line is not null)
select k doc_id, cast(arg_min(n, rank * 10 + n) as int) line_no, trim(arg_min(line, rank * 10 + n)) line from h where rank is not null and rank > 0 group by 1""",
    "planted_errors": MUTATED + "select m mutation, count(*) applied, count(*) filter (len(rules) > 0) caught from x group by 1",
    "planted_rules": MUTATED + "select mutation, rule, count(*) n from (select m mutation, unnest(rules) rule from x) group by 1, 2",
    "label_values": """select o_orderkey, case o_orderkey % 4 when 2 then 1.23 when 3 then 12.5 else cast(o_totalprice as decimal(18,2)) end::decimal(18,2) amount, case when o_orderkey % 4 < 3 then case when o_orderkey % 4 = 1 then cast(strftime(o_orderdate, '20%y-%m-%d') as date) else cast(o_orderdate as date) end end as day from orders""",
    "run_summary": GRADED + f"""select count(*) documents, {ratio('count(*) filter (ok)', 'count(*)')} success_rate, {ratio('sum(c)', 'sum(n)')} field_accuracy, cast(sum(n) as bigint) fields_graded, {MEAN} seconds_mean,
 {ratio('sum(m)', 'sum(n)')} model_page_share, cast(sum(calls) as bigint) model_calls, {ratio('count(tpl)', 'count(*)')} template_rate, count(*) filter (st = 'succeeded' and not rev) silent_successes,
 count(*) filter (st = 'succeeded' and not rev and not ok) false_successes, {ratio("count(*) filter (st = 'succeeded' and not rev and not ok)", "count(*) filter (st = 'succeeded' and not rev)")} false_success_rate,
 count(*) filter (rev) needs_review, count(*) filter (st = 'failed') failed from g""",
    "templates_used": GRADED + f"select tpl template_id, count(*) documents, {MEAN} seconds_mean from g where tpl is not null group by 1",
    "replay_summary": GRADED + f"select count(*) documents, count(*) filter (ok) fully_right, {ratio('sum(c)', 'sum(n)')} field_accuracy, count(*) filter (rev) needs_review, count(*) filter (not rev) silent_successes, count(*) filter (not rev and not ok) false_successes from g",
    "job_counts": GRADED + "select job, count(*) done, count(*) filter (st = 'succeeded') succeeded, count(*) filter (st = 'needs_review') needs_review, count(*) filter (st = 'failed') failed from g group by 1",
    "competitor_summary": GRADED + f"""select src as source, count(*) filter (not err) documents, count(*) filter (err) errors, {ratio('coalesce(sum(c) filter (not err), 0)', 'coalesce(sum(n) filter (not err), 0)')} field_accuracy,
 cast(coalesce(sum(n) filter (not err), 0) as bigint) fields_graded, count(*) filter (not err and coalesce(tm, true)) template_matched, {ratio('coalesce(sum(c) filter (not err and coalesce(tm, true)), 0)', 'coalesce(sum(n) filter (not err and coalesce(tm, true)), 0)')} field_accuracy_on_matched
 from g group by grouping sets ((src), ())""",
    "item_numbers": """with l as (select row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, cast(l_tax as decimal(6,2))) - 1 p, cast(l_tax as decimal(6,2)) t, cast(l_quantity as decimal(18,2)) q from lineitem)
select 'line_items[' || p || '].tax' path, count(*) n, cast(sum(t) as decimal(20,2)) total from l group by 1
union all select 'line_items[' || p || '].quantity', count(*), cast(sum(q) as decimal(20,2)) from l group by 1""",
}
