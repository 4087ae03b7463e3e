"""The schema gate, the registry, paths, tokens and revalidation on small cases."""

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F, types as T

from concordat.functions import paths, text
from concordat.operators import catalog, review, revalidate, schema_gate as G, tokens

INVOICE = {"invoice_number": "7", "issue_date": "2024-05-06", "seller": {"name": "S", "tax_ids": [{"value": "DE1"}]}, "buyer": {"name": "B"}, "subtotal": 10, "total_amount": "10.00", "line_items": [{"description": "x", "unit_price": 5, "total": 10, "quantity": 2}]}


def gated(spark, tree, *documents):
    rows = [(k, d if isinstance(d, str) or d is None else json.dumps(d)) for k, d in enumerate(documents)]
    return [(sorted((e.path, e.code) for e in r.errors), r.status, r.value) for r in G.gate(spark.createDataFrame(rows, "k int, document string"), tree).orderBy("k").collect()]


def test_invoice_gate(spark):
    change = lambda **k: {**INVOICE, **k}
    drop = {k: v for k, v in INVOICE.items() if k != "total_amount"}
    got = gated(
        spark, G.TREES["invoice"], INVOICE, drop, change(total_amount=None), change(total_amount=True), change(total_amount="1,5"), change(currency="EU"), change(currency=None), change(issue_date="2023-02-29"), change(due_date=None),
        change(seller=None), change(seller="x"), change(seller={}), change(line_items={}), change(line_items=[None, 5, {"description": 1, "unit_price": "x"}]), change(references=[{"kind": "letter", "number": "1"}]),
        change(tax_rate_percent=-1), change(discount_amount=-3, unknown=[1]), change(field_locations={"a.b": {"page": 0, "quote": ""}, "c": {"page": 1.0, "quote": "q"}}), "no json", "[1]", None, "", "null",
    )
    want = [
        [], [("total_amount", "missing")], [("total_amount", "type")], [], [("total_amount", "type")], [("currency", "length")], [("currency", "type")], [("issue_date", "type")], [], [("seller", "type")], [("seller", "type")],
        [("seller.name", "missing")], [("line_items", "type")],
        sorted([("line_items[0]", "type"), ("line_items[1]", "type"), ("line_items[2].description", "type"), ("line_items[2].unit_price", "type"), ("line_items[2].total", "missing")]),
        [("references[0].kind", "choice")], [("tax_rate_percent", "range")], [], sorted([("field_locations.a.b.page", "range"), ("field_locations.a.b.quote", "length")]), *[[("", "type")]] * 5,
    ]
    assert [g[0] for g in got] == want
    assert all((s == "failed") == bool(w) and (v is None) == bool(w) for (_, s, v), w in zip(got, want))
    first, off = got[0][2], got[16][2]
    assert first.total_amount == D("10") and first.issue_date == dt.date(2024, 5, 6) and first.currency == "USD" and first.tax_amount == 0 and first.seller.tax_ids[0].scheme == "other" and first.references == [] and first.field_locations == {}
    assert first.line_items[0].quantity == 2 and first.payment_account is None and off.discount_amount == 3


def test_other_trees(spark):
    r = {"merchant_name": "M", "transaction_date": "2024-01-01", "total_amount": 1, "items": [{"description": "a", "price": 1, "quantity": 0}], "card_last_four": "12a4"}
    assert gated(spark, G.TREES["receipt"], r)[0][0] == [("card_last_four", "pattern"), ("items[0].quantity", "range")]
    c = {"contract_title": "T", "effective_date": "2024-01-01", "contract_value": -1, "auto_renewal": "maybe", "notice_period_days": 2.5, "parties_a": ["x", None, 3]}
    assert gated(spark, G.TREES["contract"], c)[0][0] == [("auto_renewal", "type"), ("contract_value", "range"), ("notice_period_days", "type"), ("parties_a[1]", "type"), ("parties_a[2]", "type")]
    whole = {"contract_title": "T", "effective_date": "2024-01-01", "auto_renewal": "yes", "notice_period_days": "30"}
    v = gated(spark, G.TREES["contract"], whole)[0][2]
    assert v.auto_renewal is True and v.notice_period_days == 30 and v.non_solicit is False
    assert all(G.kind_of(t) for t in G.TREES.values())


def test_registry(spark):
    r = G.builtin()
    invoice = catalog.SCHEMAS[0]
    assert r.get("invoice")[0] is invoice and r.resolve() is None and r.resolve(schema_id="invoice", version="2.0")[0] is invoice
    tree = G.Group({"number": G.text("required"), "field_locations": G.CITED})
    for version in ("1.9", "1.10"):
        r.add(catalog.Schema("memo", version, {"number": "number"}, None, {}, ("number",), {}), tree)
    assert r.get("memo")[0].version == "1.10" and r.resolve(layout=G.kind_of(tree), version="1.9")[0].version == "1.9"
    wrong = [
        (invoice, G.TREES["invoice"]), (invoice._replace(schema_id="No Id"), G.TREES["invoice"]), (invoice._replace(schema_id="unknown"), G.TREES["invoice"]), (invoice._replace(version="2.x"), G.TREES["invoice"]),
        (invoice._replace(version="3", cited=("nothing",)), G.TREES["invoice"]), (invoice._replace(version="3", summary={"a": "seller.nothing"}), G.TREES["invoice"]), (invoice._replace(version="3", columns={"a": "nothing"}), G.TREES["invoice"]),
        (invoice._replace(version="3"), G.Group({})), (catalog.Schema("note", "1", {}, None, {}, ("number",), {}), G.Group({"number": G.text()})), (catalog.Schema("note", "1", {}, None, {}, (), {}), G.Group({"field_locations": G.text()})),
    ]
    for spec, t in wrong:
        with pytest.raises(G.SchemaError):
            r.add(spec, t)
    r.add(invoice, G.TREES["invoice"], replace=True)
    for args in ({"version": "1"}, {"schema_id": "nothing"}, {"schema_id": "invoice", "version": "9"}, {"schema_id": "invoice", "layout": G.kind_of(tree)}, {"layout": T.StructType()}, {"layout": G.kind_of(tree), "version": "7"}):
        with pytest.raises(G.SchemaError):
            r.resolve(**args)
    d = spark.createDataFrame([(" Invoice ",), ("memo",), ("UNKNOWN",), ("x",), (None,)], "a string")
    assert [x.t for x in d.select(r.answer(F.col("a")).alias("t")).collect()] == ["invoice", "memo", "unknown", "unknown", "unknown"]


def test_paths(spark):
    assert paths.parse("a.b[2][0].c") == ("a", "b", 2, 0, "c") and paths.written_as(paths.parse("a.b[2][0].c")) == "a.b[2][0].c"
    for bad in ("", "a..b", "a[x]", "[0]", "a.[1]", "a[-1]"):
        with pytest.raises(ValueError):
            paths.parse(bad)
    d = spark.createDataFrame([(1, ("n", [(1, None)])), (2, None)], "k int, a struct<n:string,l:array<struct<x:int,y:string>>>")
    assert paths.kind_at(d.schema, "a.l[3].x") == T.IntegerType() and paths.kind_at(d.schema, "a.l.x") is None and paths.kind_at(d.schema, "a.n[0]") is None
    w = paths.write(d, {"a.l[1].y": F.lit("new"), "a.l[1].z": F.col("k"), "b.c[1]": F.lit(5), "k": F.col("k") * 10, "a.n.deep": F.lit(True)}).orderBy("k").collect()
    assert [r.k for r in w] == [10, 20] and w[0].a.l[0].x == 1 and w[0].a.l[0].z is None and (w[0].a.l[1].y, w[0].a.l[1].z, w[0].a.l[1].x) == ("new", 1, None)
    assert [len(r.a.l) for r in w] == [2, 2] and w[1].a.l[0] is None and w[1].a.l[1].y == "new" and w[0].b.c == [None, 5] and w[0].a.n.deep is True


def test_documents_from_cells(spark):
    schema = T.StructType().add("a", T.StructType().add("b", "integer").add("l", T.ArrayType(T.StructType().add("x", "string").add("m", T.ArrayType(T.IntegerType()))))).add("n", "date").add("ab", "string")
    cells = [(1, "a.b", "7"), (1, "a.l[1].x", "q"), (1, "a.l[1].m[2]", "5"), (1, "n", "2024-01-01"), (1, "zz", "1"), (2, "a.b", "no"), (2, "ab", "s"), (3, "other", "1"), (4, "n", None), (4, "n", "2024-02-02"), (5, None, "1")]
    got = {r.doc_id: r for r in paths.from_cells(spark.createDataFrame(cells, "doc_id int, path string, value string"), schema).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].a.b == 7 and got[1].a.l[0] is None and got[1].a.l[1].x == "q" and got[1].a.l[1].m == [None, None, 5] and got[1].n == dt.date(2024, 1, 1)
    assert got[2].a.b is None and got[2].a.l is None and got[2].ab == "s" and got[3].a is None and got[4].n == dt.date(2024, 2, 2)
    c = spark.createDataFrame([(1, "a", 2, "q"), (1, "a", 1, "z"), (1, "b", 1, " "), (2, "c", 1, None)], "doc_id int, path string, page int, quote string")
    assert [(r.doc_id, {k: tuple(v) for k, v in r.field_locations.items()}) for r in paths.cited(c).collect()] == [(1, {"a": (1, "z")})]


def test_token_boxes(spark):
    box = lambda a, b: (float(a), 0.0, float(b), 9.0)
    rows = [
        (1, 0, "ab cd", 0.5, box(0, 50), ["a", "b c", "d"], [box(0, 1), box(1, 4), box(4, 5)]), (1, 1, "ab c", 0.6, box(0, 40), None, None), (1, 2, " ", 0.6, box(0, 40), None, None), (1, 3, "x  yz", 0.7, box(0, 40), ["x"], []),
        (1, 4, "", 0.7, box(0, 1), [" ", "  "], [box(0, 1), box(1, 2)]), (2, 0, None, 0.7, None, None, None),
    ]
    d = spark.createDataFrame(rows, f"page int, line int, text string, confidence double, box {tokens.BOX}, tokens array<string>, token_boxes array<{tokens.BOX}>")
    got = [(r.line, r.word, r.text, r.x0, r.x1) for r in tokens.words_of_lines(d).orderBy("page", "line", "word").collect()]
    assert got == [(0, 0, "ab", 0.0, 4.0), (0, 1, "cd", 1.0, 5.0), (1, 0, "ab", 0.0, 20.0), (1, 1, "c", 30.0, 40.0), (3, 0, "x", 0.0, 10.0), (3, 1, "yz", 20.0, 40.0)]
    assert {r.page: r.height for r in tokens.line_height(d).collect()} == {1: 9.0, 2: 0.0}
    assert [(r.line, r.text, r.box) for r in tokens.text_only(spark.createDataFrame([(1, "a\n \nb")], "page int, text string")).collect()] == [(0, "a", None), (1, "b", None)]


def test_canonical_json(spark):
    rows = [('{"b":1.005,"a":[1,2.50]}',), ('{"a":[1,2.499999],"b":1.0}',), ("no",), (None,), ('{"x":-0.001}',), ('"é"',)]
    got = [r.x for r in spark.createDataFrame(rows, "s string").select(text.canonical_json("s").alias("x")).collect()]
    assert got == ['{"a":[1,2.5],"b":1.0}', '{"a":[1,2.5],"b":1.0}', None, None, '{"x":0.0}', '"é"']


def test_rounds_of_revalidation(spark):
    """Several refusals of one task: what is refused is not merged into what comes later."""
    at = dt.datetime(2024, 1, 1)
    steps = [("enqueue", None), ("claim", None), ("corrected", {"currency": "EURO"}), ("corrected", {"total_amount": 11}), ("approved", {"due_date": "2024-06-01"}), ("approved", {"subtotal": 11}), ("approved", None)]
    rows = [(1, i, kind, "ann", at + dt.timedelta(seconds=i), 600 if kind == "claim" else None, None, None if c is None else json.dumps(c)) for i, (kind, c) in enumerate(steps)]
    rows += [(2, i, kind, "ann", at + dt.timedelta(seconds=i), 600 if kind == "claim" else None, None, None) for i, kind in enumerate(("enqueue", "claim", "approved"))]
    log = spark.createDataFrame(rows, "task int, seq int, kind string, who string, at timestamp, lease_s int, expected_version long, corrections string")
    one = {**INVOICE, "line_items": [], "seller": {"name": "S"}}
    docs = spark.createDataFrame([(1, json.dumps(one))], "task int, document string")
    out = review.revisions(revalidate.decided(log, docs, revalidate.invoice_verdicts())).collect()
    assert {(r.task, r.seq): r.refusal for r in out if r.refusal} == {(1, 2): "schema", (1, 4): "errors", (1, 6): "no_lock", (2, 2): "schema"}
    state = {r.task: r for r in review.queue_state(revalidate.decided(log, docs, revalidate.invoice_verdicts())).collect()}
    assert state[1].state == "approved" and json.loads(state[1].corrections) == {"subtotal": 11, "total_amount": 11} and state[2].state == "in_review"


def test_answers_with_white_space_around(spark):
    d = spark.createDataFrame([(0, " Invoice\n"), (1, "\t RECEIPT\r\n"), (2, "way\nbill"), (3, "\n"), (4, None)], "i int, a string")
    assert [x.t for x in d.select("i", G.builtin().answer(F.col("a")).alias("t")).orderBy("i").collect()] == ["invoice", "receipt", "unknown", "unknown", "unknown"]


def test_faults_are_found_once_for_each_document(spark):
    import re

    from concordat.plans import gate

    plan = gate.schema_faults(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Filter .*size\(", plan)  # a filter inferred from the generator finds all faults again


def test_cells_are_dealt_once(spark):
    cells = spark.createDataFrame([(1, "a.b[1].c", "2"), (1, "a.b[10].c", "3"), (1, "a.bc", "4"), (2, "ab", "5")], "doc_id int, path string, value string")
    kind = T.StructType().add("a", T.StructType().add("b", T.ArrayType(T.StructType().add("c", T.IntegerType()))))
    docs = paths.from_cells(cells, kind)
    assert docs._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + docs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.doc_id: r.a for r in docs.collect()}
    assert got[2] is None and len(got[1].b) == 11 and [x and x.c for x in got[1].b] == [None, 2, *[None] * 8, 3]


def test_rounds_share_the_expressions_of_the_gate(monkeypatch):
    class Stop(Exception):
        pass

    made, seen = [], []

    def gate(docs, tree, made):
        seen.append(made)
        raise Stop

    monkeypatch.setattr(G, "expressions", lambda tree: made.append(tree) or ("faults", "value"))
    monkeypatch.setattr(G, "gate", gate)
    check = revalidate.invoice_verdicts()
    for _ in range(2):
        with pytest.raises(Stop):
            check(None)
    assert made == [G.TREES["invoice"]] and seen == [("faults", "value")] * 2
