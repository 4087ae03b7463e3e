"""Operators on small tables written by hand."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from concordat.operators import catalog, classify, export, layout, matching, metrics, quotes, review, templates, validation
from concordat.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


LINE = "id int, pos int, sku string, description string, quantity decimal(18,2), unit_price decimal(18,2)"


def test_order_lines_last_wins_and_sku_falls_back(spark):
    order = spark.createDataFrame([(1, 1, "A", "bolt", D("5"), D("1.00")), (1, 2, "a ", "bolt", D("9"), D("2.00")), (1, 3, None, "nut", D("4"), D("1.00"))], LINE)
    bill = spark.createDataFrame([(1, 1, "A", "x", D("9"), D("2.00")), (1, 2, "ZZ", " NUT", D("4.01"), D("1.02")), (1, 3, None, "gasket", D("1"), D("1"))], LINE)
    got = rows(matching.line_discrepancies(matching.matched_lines(bill, order)).select("type", "expected", "actual", "difference"), "type")
    assert got == [("price_variance", "1.00", "1.02", D("0.02")), ("unordered_item", None, "gasket", None)]
    three = matching.three_way(bill, order, order).select("type")
    assert sorted(r[0] for r in rows(three)) == ["unfulfilled_billing", "unfulfilled_billing", "unordered_item", "unordered_item"]


def test_receipts_and_transactions(spark):
    d = lambda n: dt.date(2024, 1, n)
    receipts = spark.createDataFrame([(1, d(10), "eur", None, D("10.00")), (2, d(10), "EUR", "1234", D("20.00")), (3, d(10), "EUR", None, D("99.97")), (4, d(10), "EUR", None, D("5"))], "id int, date date, currency string, card string, total decimal(18,2)")
    bank = spark.createDataFrame([(1, 1, d(13), "EUR", None, D("-10.05")), (2, 2, d(14), "EUR", None, D("10.00")), (3, 3, d(9), "EUR", "9999", D("20.00")), (4, 4, d(9), "EUR", "", D("20.00")), (5, 5, d(11), "EUR", None, D("100.00")), (6, 6, d(10), "EUR", None, D("100.02")), (7, 7, d(10), "USD", None, D("5"))], "transaction_id int, ordinal int, date date, currency string, card string, amount decimal(18,2)")
    got = rows(matching.receipt_to_transactions(receipts, bank), "id")
    assert got == [(1, "matched", 1, 1, False), (2, "matched", 1, 4, False), (3, "matched", 2, 6, True), (4, "unmatched", 0, None, False)]


def test_names_without_letters_compare_equal_unless_guarded(spark):
    h = spark.createDataFrame([(1, "p", "EUR", "Ω", "b", D("1"))], "id int, po_number string, currency string, seller string, buyer string, total decimal(18,2)")
    o = h.withColumn("seller", F.lit("Ж"))
    none = spark.createDataFrame([], LINE)
    assert rows(matching.invoice_to_order(h, none, o, none)[0]) == []
    assert rows(matching.invoice_to_order(h, none, o.withColumn("seller", F.lit("Acme")), none)[0].select("type")) == [("party_mismatch",)]


def test_reasons_and_status(spark):
    x = spark.createDataFrame([(1, None, True, "invoice", 0.9, [], True, [("total", "error"), ("bic", "warning")], ["date"]), (2, "acquire", False, "unknown", 0.1, [1], False, [], []), (3, None, True, "invoice", 0.55, [], True, [], [])],
                              "id int, error_stage string, complete boolean, doc_type string, confidence double, degraded_pages array<int>, extracted boolean, issues array<struct<field:string,severity:string>>, weak_fields array<string>")
    x = x.withColumn("reasons", review.reasons()).withColumn("status", review.status(F.col("error_stage"), F.col("reasons")))
    got = {r.id: (r.status, [(q.code, q.field) for q in r.reasons]) for r in x.collect()}
    assert got == {1: ("needs_review", [("validation_error", "total"), ("low_confidence", "date")]), 2: ("failed", [("failed", None)]), 3: ("succeeded", [])}


def test_weak_fields_and_reconciled(spark):
    w = spark.createDataFrame([(1, "total", "18.15", "Total:", 0.1), (1, "total", "18.15", "18.15", 0.9), (1, "date", "2024-01-02", "7", 0.5), (1, "tax", "3", "3", None)], "doc_id int, field string, value string, word string, confidence double")
    assert rows(review.weak_fields(w)) == [(1, "date", 0.5)]
    d = spark.createDataFrame([(1, D("10"), D("1"), None, None, D("11"), "sub 10", "tot 11", []), (2, D("10"), None, None, None, D("12"), "a", "a", [D("4"), D("6")]), (3, D("10"), D("1"), None, None, D("11"), "same", "same", [D("10")])], "doc_id int, subtotal decimal(18,2), tax decimal(18,2), shipping decimal(18,2), discount decimal(18,2), total decimal(18,2), subtotal_quote string, total_quote string, row_totals array<decimal(18,2)>")
    assert rows(review.reconciled(d), "doc_id", "field") == [(1, "subtotal"), (1, "total_amount"), (2, "subtotal")]


def test_queue_and_merge(spark):
    at = dt.datetime(2024, 1, 1, 12)
    fix = '{"a": {"b": 1}}'
    log = [  # task, seq, kind, who, seconds, lease, expected version, corrections, errors
        (1, 1, "enqueue", "s", 0, None, None, None, None), (1, 2, "claim", "ann", 0, 60, None, None, None), (1, 3, "claim", "bob", 30, 60, None, None, None), (1, 4, "corrected", "ann", 40, None, 2, fix, 0),
        (1, 5, "corrected", "ann", 41, None, 2, fix, 0), (1, 6, "approved", "ann", 50, None, None, None, 1), (1, 7, "release", "bob", 55, None, None, None, None), (1, 8, "release", "ann", 56, None, None, None, None),
        (2, 1, "enqueue", "s", 0, None, None, None, None), (2, 2, "claim", "ann", 0, 20, None, None, None), (2, 3, "claim", "bob", 20, 60, None, None, None), (2, 4, "corrected", "ann", 21, None, None, fix, 0),
        (3, 1, "claim", "x", 0, 60, None, None, None), (3, 2, "enqueue", "s", 1, None, None, None, None), (3, 3, "claim", "x", 2, 5, None, None, None), (3, 4, "claim", "x", 3, 3600, None, None, None),
        (3, 5, "approved", "x", 4, None, 2, '{"a": {"c": 2}}', 0), (4, 1, "enqueue", "s", 0, None, None, None, None), (4, 2, "claim", "x", 1, 60, None, None, None), (4, 3, "enqueue", "s", 2, None, None, None, None), (4, 4, "moved", "x", 3, None, None, None, None),
    ]
    kinds = "task int, seq int, kind string, who string, at timestamp, lease_s int, expected_version bigint, corrections string, errors int"
    e = spark.createDataFrame([(*x[:4], at + dt.timedelta(seconds=x[4]), *x[5:]) for x in log], kinds)
    state = review.queue_state(e)
    assert rows(state.select("task", "state", "version", "locked_by", "corrections", "refused"), "task") == [
        (1, "corrected", 4, None, fix, 4), (2, "in_review", 3, "bob", None, 1), (3, "approved", 3, None, '{"a": {"c": 2}}', 2), (4, "pending", 3, None, None, 1),
    ]
    assert [r.refusal for r in review.revisions(e).where("task < 4").orderBy("task", "seq").collect()] == [
        None, None, "locked", None, "version", "errors", "no_lock", None, None, None, None, "no_lock", "missing", None, "lease", None, None,
    ]
    assert [r.task for r in review.pending(state).collect()] == [1, 2, 4]
    locked = lambda s: [r.locked for r in review.with_lock(state, F.lit(at + dt.timedelta(seconds=s))).orderBy("task").collect()]
    assert locked(79) == [False, True, False, False] and locked(81) == [False] * 4
    d = spark.createDataFrame([('{"a": {"b": 1, "c": [1]}, "d": 2}', '{"a": {"b": 5, "c": [2, 3]}}')], "x string, y string")
    assert rows(d.select(review.deep_merge("x", "y"))) == [('{"a": {"b": 5, "c": [2, 3]}, "d": 2}',)]


def test_layout(spark):
    w = [(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 2.0, 0.1, 3.0, 1.1), (1, 3, 9.0, 0.0, 9.5, 1.0), (1, 4, 0.0, 2.0, 1.0, 3.0), (1, 5, 0.5, 2.0, 1.5, 3.0)]
    d = spark.createDataFrame(w, "page int, word int, x0 double, y0 double, x1 double, y1 double")
    r = layout.rows_of_words(d)
    assert rows(r, "word") == [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 1), (1, 5, 2)]
    s = layout.segments(d.join(r, ["page", "word"]), ["page", "row"], F.lit(1.0))
    assert [x.segment for x in s.orderBy("word").collect()] == [0, 0, 1, 0, 0]
    bands = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 6, 7), (1, 7, 9)], "k int, lo int, hi int")
    assert rows(layout.merge_bands(bands, ["k"], "lo", "hi"), "lo") == [(1, 0, 5, 2), (1, 6, 9, 2)]
    words = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.0, 1.0, "1.2", 0.9), (1, 1, 1.1, 2.0, 0.0, 1.0, "34,50", 0.8), (1, 1, 5.0, 6.0, 0.0, 1.0, "7.00", 0.3), (1, 1, 8.0, 9.0, 0.0, 1.0, "5", 0.9)], "page int, line int, x0 double, x1 double, y0 double, y1 double, text string, confidence double")
    assert [[float(a) for a in r.amounts] for r in layout.witness_amounts(words).collect()] == [[1234.5, 5.0]]
    q = spark.createDataFrame([(1, "a", "abc", "xabcabcx"), (1, "b", "invoicenumber42", "zzinvo1cenumber42zz"), (1, "c", "nothing", "xabcabcx")], "doc_id int, field string, quote string, page_text string")
    found = rows(quotes.locate(q).select("field", "start", "end"), "field", "start")
    assert found == [("a", 1, 4), ("a", 4, 7), ("b", 2, 17)]
    box = spark.range(1).select(layout.rotated(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.5), F.lit(90)).alias("b")).first().b
    assert [round(x, 6) for x in box] == [0.5, 0.1, 0.8, 0.3]
    c = spark.createDataFrame([(1, 0.0, 1.0, "ab cd")], "cell int, x0 double, x1 double, text string")
    assert rows(layout.split_cell(c).select("word", "w0", "w1"), "word") == [("ab", 0.0, 0.5), ("cd", 0.5, 1.0)]


def test_chain_of_readings(spark):
    r = spark.createDataFrame([(1, 1, "", 0.9, True), (1, 2, "a", 0.5, True), (1, 3, "b", 0.6, False), (1, 4, "c", 0.9, True), (2, 1, "x", 0.3, True), (2, 2, "y", 0.4, False), (3, 1, " ", 0.9, True)], "page int, ordinal int, text string, confidence double, geometry boolean")
    assert rows(layout.first_acceptable(r).select("page", "ordinal", "degraded", "witness"), "page") == [(1, 3, False, 2), (2, 2, True, None), (3, None, True, None)]
    a = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (2, 1, 0), (2, 2, 1)], "doc_id int, attempt int, errors int")
    assert rows(layout.escalation_winner(a), "doc_id") == [(1, 2, 2), (2, 1, 0)]


def test_exports(spark, tmp_path):
    h = spark.createDataFrame([(1, D("100"), D("19.00"), None, None), (2, D("100"), D("10.00"), None, None), (3, D("5"), D("0"), None, None), (4, D("30"), D("5.00"), D("1"), None)], "id int, subtotal decimal(18,2), tax decimal(18,2), discount decimal(18,2), shipping decimal(18,2)")
    l = spark.createDataFrame([(1, D("60"), D("19")), (1, D("40"), D("19")), (2, D("100"), D("19")), (4, D("10"), D("10")), (4, D("20"), D("20"))], "id int, net decimal(18,2), rate decimal(8,2)")
    got = rows(export.semantic_totals(h, export.vat_breakdown(l), l).select("id", "payable", "refusal"), "id")
    assert got == [(1, D("119.00"), None), (2, D("110.00"), "tax"), (3, None, "BR-16"), (4, D("34.00"), "mixed rates")]
    j = spark.createDataFrame([(1, '{"a/b": {"c~": [1, true, null, {}]}, "d": "x"}')], "id int, j string")
    assert rows(export.flatten_json(j, "j", "id").select("path", "type", "value"), "path") == [("/a~1b/c~0/0", "number", "1"), ("/a~1b/c~0/1", "boolean", "true"), ("/a~1b/c~0/2", "null", ""), ("/a~1b/c~0/3", "object", ""), ("/d", "string", "x")]
    sinks.write_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "c"))
    assert rows(spark.read.option("header", "true").csv(str(tmp_path / "c"))) == [("'=1+1", "2")]
    kind = spark.createDataFrame([('<a:Invoice xmlns:a="u"><b:CustomizationID> urn:x </b:CustomizationID></a:Invoice>',), ("<none/>",)], "x string").select(readers.einvoice_profile(F.col("x"))).collect()
    assert [r[0] for r in kind] == ["ubl urn:x", ""]


def test_metrics(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "doc_id int, field string, value string")
    g = spark.createDataFrame([(1, "a", "x"), (2, "a", "n"), (4, "b", "q")], "doc_id int, field string, value string")
    got = {r.field: (r.tp, r.fp, r.fn, float(r.f1)) for r in metrics.field_prf(p, g).collect()}
    assert got == {"a": (1, 1, 1, 0.5), "b": (0, 1, 1, 0.0), "_micro": (1, 2, 2, 0.333333)}
    i = lambda v: spark.createDataFrame(v, "doc_id int, pos int, description string, amount double")
    m = metrics.item_matches(i([(1, 1, "red bolt", 5.0), (1, 2, "red bolts", 5.0)]), i([(1, 1, "Red bolt", 5.005), (1, 2, "nut", 5.0)]))
    assert rows(m.select("pairs", "predicted", "gold")) == [(1, 2, 2)]
    c = spark.createDataFrame([(1, 1, 1, 0, "a"), (1, 1, 2, 0, "b"), (1, 2, 0, 0, "b")], "doc_id int, table int, row int, col int, text string")
    gold = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (2, 0, 0, "a")], "doc_id int, row int, col int, text string")
    assert rows(metrics.table_hits(c, gold), "doc_id") == [(1, 2), (2, 0)]


def test_templates(spark):
    t = (templates.Template("acme", ("acme", "invoice"), (templates.Field("total", "total", r"([\d.,]+)", 1, "amount"), templates.Field("date", "date", r"(\d\S+)", 0, "date"), templates.Field("none", "zzz", "(x)"))), templates.Template("any", ("invoice",)))
    d = spark.createDataFrame([(1, "ACME Ltd\nInvoice\nTotal due\n 1.234,50\nDate: 3/4/2024"), (2, "Other invoice"), (3, "letter")], "doc_id int, text string")
    assert [r[0] for r in rows(d.select(templates.which(F.col("text"), t)))] == ["acme", "any", None]
    assert rows(templates.extract(d, t), "field") == [(1, "acme", "date", "2024-04-03"), (1, "acme", "total", "1234.500000")]
    c = spark.createDataFrame([(1, 0, 0, "Item"), (1, 0, 1, "Price"), (1, 1, 0, "bolt"), (1, 1, 1, "1,50")], "p int, row int, col int, text string")
    assert [(r.name, float(r.price)) for r in templates.table_rows(c, {0: ("name", "text"), 1: ("price", "amount")}, ["p"]).collect()] == [("bolt", 1.5)]


def test_classifier_and_cascade(spark):
    e = [(f"invoice due payment bank {i}", "invoice") for i in range(8)] + [(f"party agreement law clause {i}", "contract") for i in range(4)]
    model = classify.train(spark.createDataFrame(e, "text string, label string"), features=256)
    assert classify.train(spark.createDataFrame(e[:8], "text string, label string")) is None
    d = spark.createDataFrame([(1, "invoice payment due"), (2, "clause of law agreement"), (3, "rule hit"), (4, "qqq")], "doc_id int, text string")
    rules = spark.createDataFrame([(3, "receipt", 1.0)], "doc_id int, doc_type string, confidence double")
    got = {r.doc_id: (r.doc_type, r.method) for r in classify.cascade(d, rules, model, floor=0.75).collect()}
    assert got[1] == ("invoice", "tfidf") and got[2] == ("contract", "tfidf") and got[3] == ("receipt", "rules") and got[4][1] == "tfidf"
    assert {r.method for r in classify.cascade(d, rules, None).collect()} == {"rules", "none"}
    v = spark.createDataFrame([(1, "a", 0.4), (1, "b", 0.3), (1, "b", 0.3)], "doc_id int, doc_type string, confidence double")
    assert [(r.doc_type, round(r.confidence, 2)) for r in classify.chunk_votes(v).collect()] == [("b", 0.6)]


def test_catalog(spark):
    s = spark.createDataFrame([("a", "1.9"), ("a", "1.10"), ("b", "2.0")], "schema_id string, version string")
    assert rows(catalog.latest(s), "schema_id") == [("a", "1.10"), ("b", "2.0")]
    flat = spark.createDataFrame([("1.0", "A", "DE1", "B", None), ("2.0", "C", None, "D", None)], "schema_version string, seller_name string, seller_vat string, buyer_name string, buyer_vat string")
    out = catalog.migrate(flat, {"1.0": ("2.0", catalog.parties_from_flat)}, "2.0").where("seller is not null").collect()
    assert [(r.schema_version, r.seller.name, [t.value for t in r.seller.tax_ids], r.buyer.tax_ids) for r in out] == [("2.0", "A", ["DE1"], [])]
    assert catalog.personal_paths(spark).where("schema_id = 'invoice' and category = 'identifier'").count() == 2


def test_citations_and_witness(spark):
    need = spark.createDataFrame([(1, "total"), (1, "items"), (1, "date")], "doc_id int, field string")
    have = spark.createDataFrame([(1, "total", True), (1, "items[0].price", True), (1, "date", False)], "doc_id int, field string, page_exists boolean")
    assert rows(validation.citations_missing(need, have)) == [(1, "date")]
    page = spark.createDataFrame([(1, "Total 450.00"), (1, "Tax 7.75")], "doc_id int, line string")
    seen = spark.createDataFrame([(1, "TOTAL 480.00"), (1, "tax 775")], "doc_id int, line string")
    assert rows(validation.witness_contradictions(page, seen)) == [(1, "total", ["45"])]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ftwo")
    (tmp_path / "in/b.exe").write_text("x")
    (tmp_path / "in/c.txt").write_text("y" * 100)
    good, bad = readers.scan(spark, str(tmp_path / "in"), most_bytes=50)
    assert rows(readers.text_pages(good).select("page", "text"), "page") == [(1, "one"), (2, "two")]
    assert sorted(r.reason for r in bad.collect()) == ["file_too_large", "unsupported_document"]
    (tmp_path / "r.jsonl").write_text('{"source": "a", "status": "failed"}\n{"source": "a", "status": "ok"}\n{"source": "b", "sta')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("status", T.StringType())])
    assert rows(readers.checkpoint_rows(spark, str(tmp_path / "r.jsonl"), schema)) == [("a", "ok")]
    ok, broken = readers.vendor_json(spark, str(tmp_path / "r.jsonl"), schema)
    assert ok.count() == 2 and broken.count() == 1


def test_receipts_meet_cells_of_transactions(spark):
    """Equal rows count without being paired, and a tolerance of several units covers all amounts within it."""
    n = 30_000
    day, eur, money = F.lit("2024-01-05").cast("date"), F.lit("EUR"), "decimal(18,2)"
    receipts = spark.range(n).select("id", day.alias("date"), eur.alias("currency"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("card"), F.lit("10.00").cast(money).alias("total"))
    bank = spark.range(n).select(
        F.col("id").alias("transaction_id"), (-F.col("id")).alias("ordinal"), F.date_add(day, F.when(F.col("id") == n - 1, 1).otherwise(0)).alias("date"), eur.alias("currency"),
        F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("card"), F.when(F.col("id") % 2 == 0, "-8.50").otherwise("12.51").cast(money).alias("amount"),
    )
    got = {(r.id % 3, r.status, r.n_candidates, r.transaction_id) for r in matching.receipt_to_transactions(receipts, bank, tolerance="2.5").collect()}
    # Amounts of 8.50 are of even ids: cards none and 2.
    assert got == {(0, "matched", n // 2, n - 2), (1, "matched", n // 4, n - 4), (2, "matched", n // 2, n - 2)}
