"""Cited values, summaries and searches on hand-made rows."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from concordat.operators import citations, runs


def rows(df, *by):
    return sorted(tuple(r) for r in df.collect())


def test_cited_values(spark):
    day = dt.date(2026, 6, 1)
    c = spark.createDataFrame([
        (1, "issue_date", day, "TAX INVOICE", ""), (2, "issue_date", day, "01.06.2026", "30.06.2026"), (3, "issue_date", day, "06/01/2026", "30.06.2026"), (4, "issue_date", day, "06/01/2026", ""), (5, "issue_date", day, "1 June 2026", None),
        (6, "issue_date", day, "2 June 2026", None), (7, "issue_date", day, "Room 12", None), (8, "issue_date", None, "x", None), (9, "issue_date", day, " ", None),
    ], "doc_id int, field string, day date, quote string, page_text string")
    assert [r[0] for r in rows(citations.cited_dates(c))] == [1, 3, 6]
    c = spark.createDataFrame([
        (1, "invoice_number", "INV-2026-001", "Invoice INV 2026/001"), (2, "invoice_number", "INV-2026-001", "Invoice"), (3, "invoice_number", "--", None), (4, "invoice_number", "A1", None), (5, "seller.name", "A1", "B"), (6, "po_number", None, "B"),
    ], "doc_id int, field string, value string, quote string")
    assert [r[0] for r in rows(citations.cited_identifiers(c))] == [2, 3]
    c = spark.createDataFrame([
        (1, "seller.name", "Acme Supply Ltd", "Acrne Supply"), (2, "seller.name", "Acme Supply", "Total"), (3, "buyer.contact_name", "Bob", "x"), (4, "parties_a[0]", "GmbH", "x"), (5, "account_holder", "Zed", None), (6, "supplier", "Acme", "x"),
    ], "doc_id int, field string, value string, quote string")
    assert [r[0] for r in rows(citations.cited_names(c))] == [2]


def test_renderings_and_labels(spark):
    got = spark.range(1).select(citations.amount_renderings(F.lit("1234.50").cast("decimal(18,2)")).alias("a"), citations.amount_renderings(F.lit("7.00").cast("decimal(18,2)")).alias("b")).first()
    assert got.a == ["1,234.50", "1234.50", "1 234,50", "1.234,50", "1234,50"] and got.b == ["7.00", "7,00", "7"]
    d = spark.createDataFrame([("1.234,56", "05/11/20"), ("1,234.56", "17-03-2019"), ("1.234", "2019-02-2"), ("x", "30.02.2019"), (" ", "2019-02-20")], "a string, d string")
    out = d.select(citations.label_amount(F.col("a")).alias("a"), citations.label_date(F.col("d")).alias("d")).collect()
    assert [r.a for r in out] == [D("1234.56"), D("1234.56"), D("1.23"), None, None] and [r.d for r in out] == [dt.date(2020, 11, 5), dt.date(2019, 3, 17), None, None, dt.date(2019, 2, 20)]


def test_uploads_search_and_results(spark):
    f = spark.createDataFrame([(1, "a.pdf", 5, 1), (1, "b.exe", 5, 1), (1, "c.pdf", 50, 1), (2, "d.pdf", 9, 9), (3, "e.pdf", 9, 1), (3, "f.PDF", 9, 1)], "upload int, name string, bytes int, pages int")
    assert rows(runs.upload_checks(f, ("pdf",), 20, 100, 3)) == [(1, "b.exe", "unsupported_document"), (1, "c.pdf", "file_too_large"), (2, "d.pdf", "too_many_pages")]
    assert [r[2] for r in rows(runs.upload_checks(f.where("upload = 3"), ("pdf",), 20, 10, 3))] == ["upload_too_large"] * 2
    d = spark.createDataFrame([("Re 100%", 1), ("re 100 x", 2), ("RE 100% b", 3)], "name string, created int")
    assert [r.created for r in runs.searched(d, "re 100%").collect()] == [3, 1]
    j = spark.createDataFrame([("j", "s1", 1, "failed"), ("j", "s1", 2, "succeeded"), ("j", "s2", 1, "failed")], "job string, stored string, seq int, status string")
    u = spark.createDataFrame([("j", 2, "s1", "one"), ("j", 1, "s2", "two"), ("j", 3, "s3", "three")], "job string, position int, stored string, name string")
    assert [(r.name, r.status) for r in runs.job_results(j, u).collect()] == [("two", "failed"), ("one", "succeeded"), ("three", None)]
    assert [r[0] for r in spark.createDataFrame([("zf_1",), ("receipt_hf_2",), ("x",)], "n string").select(runs.collection(F.col("n"))).collect()] == ["zugferd", "cord", "golden"]
