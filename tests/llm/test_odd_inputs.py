"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from concordat.llm import embeddings, line_templates, mixing, order_minhash, packing, preference, pseudo_likelihood, quality_rules, secrets, url_templates
from concordat.llm.catalog import tokenizer_files
from tests.llm.helpers import empty_docs, labels, odd_docs

RUNS = {
    "lm": lambda s, d: pseudo_likelihood.pseudo_likelihood(d),
    "rules": lambda s, d: quality_rules.judge(d, labels(s)),
    "secrets": lambda s, d: secrets.digest(secrets.scan(d)),
    "ranking": lambda s, d: preference.rank(d, labels(s)),
    "lines": lambda s, d: line_templates.dedup(d),
    "minhash": lambda s, d: order_minhash.classes(d),
    "mixing": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_document(spark, name):
    for extra in (False, True):
        d = odd_docs(spark, extra)
        out = RUNS[name](spark, d).collect()
        assert len(out) == d.count()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in d.select("doc_id").collect())


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, empty_docs(spark)).collect() == []


def test_packing_odd(spark):
    for d in (odd_docs(spark), odd_docs(spark, True)):
        out = packing.pack(d, **tokenizer_files()).toPandas()
        assert (out[out.doc_id == 3].length == 1).all() and (out[out.doc_id == 4].doc_tokens == 1).all()
        assert len(out[(out.doc_id == 2) & (out.start == 0)]) == 2
        assert out.doc_id.isna().sum() >= 1
    assert packing.pack(empty_docs(spark), **tokenizer_files()).collect() == []


def test_labels_of_one_value_or_none(spark):
    d = odd_docs(spark)
    none = labels(spark, ())
    assert not any(r.kept and r.base_failed for r in quality_rules.judge(d, none).collect())
    assert {r.score for r in preference.rank(d, none).collect()} == {0.5}
    only = labels(spark, ((1, 1), (2, 1)))
    assert quality_rules.judge(d, only).where("not base_failed and not kept").count() == 0


def test_embeddings_odd(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [float("nan"), 1.0, 1.0], 0), (9, [float("inf"), 1.0, 1.0], 0),
        (10, v, None), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0), (13, [1e30, 2e30, 3e30], 0), (14, [-0.0, 0.0, 5.0], 0), (15, [0.0, -0.0, 5.0], 0),
    ]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("key", F.lit("x"))
    out = {r.vec_id: r for r in embeddings.near_duplicates(d).collect()}
    assert [out[i].n_links for i in (1, 2, 11, 13)] == [4, 4, 4, 4] and out[13].component_id == 1 and not out[2].kept
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in (3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert out[15].component_id == 14 and out[14].n_links == 1
    assert embeddings.near_duplicates(d.limit(0)).collect() == []


def test_urls_odd(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "x://A.Example.COM?q"), (5, "x://A.Example.COM?q"), (None, "http://h/a/b/c/d/e/f"), (6, "http://com/en/1"), (7, "http://notcom/en/1#f"), (8, "http://x.example.com/en/71?z")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("steps", F.lit(1))
    out = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(d).collect()), key=str)
    got = {x[0]: x[1:] for x in out}
    assert len(out) == 10 and got[1] == got[2] == got[3] == ("", "", None, "allow") and got[5] == ("a.example.com", "", None, "allow")
    assert got[6] == ("com", "/en/1", "com/en/", "block") and got[7] == ("notcom", "/en/1", None, "allow") and got[8] == ("x.example.com", "/en/71", "example.com/en/7", "allow")
    assert url_templates.judge(d.limit(0)).collect() == []


#: Names that the operators' own tables use, and names that need quotes.
INNER = ("rest", "passes", "edge", "last", "fill", "source_size", "target", "taken", "__size", "__rank", "__pattern", "__of", "__r1", "__r2", "a.b", "back`tick", "pos", "leaf", "h", "doc", "n_lines", "n_dropped", "dropped_at", "__column0", "with space")


def test_columns_of_any_name(spark):
    d = odd_docs(spark)
    wide = d.select("*", *[F.lit(name).alias(name) for name in INNER])
    own = lambda rows: sorted((str((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in rows))
    mixed = mixing.mix(wide)
    assert own(mixed.collect()) == own(mixing.mix(d).collect())
    left = [c for c in INNER if c not in ("source_size", "target", "taken")]
    assert mixed.columns == [*d.columns, *left, "size", "source_size", "target", "taken"] and {tuple(r[c] for c in left) for r in mixed.collect()} == {tuple(left)}
    lines = line_templates.dedup(wide)
    texts = lambda rows: sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in rows)
    assert texts(lines.collect()) == texts(line_templates.dedup(d).collect())
    left = [c for c in INNER if c not in ("n_lines", "n_dropped", "dropped_at")]
    assert lines.columns == [*d.columns, *left, "n_lines", "n_dropped", "dropped_at"] and {tuple(r[c] for c in left) for r in lines.collect()} == {tuple(left)}


def test_deep_paths(spark):
    """Traps of a crawler: paths that share 60 steps, and paths that branch at every one of 12."""
    import time

    deep = [f"http://trap.example/{'a/' * 60}{leaf}" for leaf in ("b", "c", "d/e", "d/f")]
    steps = [f"http://steps.example/{'a/' * k}{leaf}" for k in range(12) for leaf in ("b", "c")]
    d = spark.createDataFrame(list(enumerate([*deep, *deep[:2], *steps])), "page_id long, url string")
    began = time.time()
    out = {r.page_id: r.template for r in url_templates.judge(d).collect()}
    assert time.time() - began < 120
    assert [out[k] for k in range(6)] == ["/" + "a/" * 60 + x for x in ("b", "c", "d/e", "d/f", "b", "c")]
    assert [out[6 + k] for k in range(24)] == [u.partition("steps.example")[2] for u in steps]
