"""The pipeline's stages, each against what its operator says of its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concordat.llm import line_templates, mixing, order_minhash, packing, quality_rules
from concordat.llm.catalog import read, tokenizer_files
from tests.llm.helpers import DOCS, empty_docs, odd_docs, prose

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages(spark, tmp_path):
    docs = read(spark, SF, "documents")
    cols = docs.dtypes
    at = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at[name] = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.dtypes == cols
        at[name + " out"] = docs
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(at["quality rules out"]) == ids(quality_rules.judge(at["quality rules"], read(spark, SF, "labels")).where("kept"))
    changed = {r.doc_id: r.text for r in line_templates.dedup(at["line dedup"], most_dropped=corpus_pipeline.WHOLE_COPY).collect()}
    kept = at["line dedup out"].collect()
    assert all(changed[r.doc_id] == r.text and r.n_chars == len(r.text) for r in kept)
    assert {i for i, t in changed.items() if t.split()} == {r.doc_id for r in kept}
    assert ids(at["MinHash near-dedup out"]) == ids(order_minhash.classes(at["MinHash near-dedup"]).where("kept"))
    mix = {r.doc_id: r.taken // r.size for r in mixing.mix(at["mixing sources to target weights"]).collect() if r.size}
    assert ids(at["mixing sources to target weights out"]) == sorted(i for i, n in mix.items() for _ in range(n))
    packed = packing.pack(at["packing"], **tokenizer_files())
    assert packed.agg({"length": "sum"}).first() == at["packing out"].agg({"length": "sum"}).first()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and out.count() > 0


CLASH = ("kept", "n_words", "base_failed", "p_quality", "n_lines", "n_dropped", "dropped_at", "size", "taken", "target", "source_size", "t1", "class_id", "__id", "__copy", "a.b", "ids")


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, k):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with the names of operators' columns."""
    line = prose(4077, 60)
    more = [(100 + i, prose(100 + i, 90) + "\n" + line, "en", "abc"[i % 3], 1) for i in range(12)]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(more, DOCS))
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    if k == 4:
        assert out.where("start = 0").count() == docs.count()
        return
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    if k != 1:
        assert {(r.doc_id, r.text) for r in rows} <= text
    ids = [r.doc_id for r in rows]
    if name == "line dedup":  # the passage stays in the document with the smallest id; nulls and empty texts pass
        assert len(rows) == docs.count() and sum(line in (r.text or "") for r in rows) == 1 and line in {r.doc_id: r.text for r in rows}[100]
        assert all(r.n_chars == len(r.text) for r in rows if 100 < (r.doc_id or 0) < 200)
    if name == "MinHash near-dedup":  # of the copies 1, 2, 2, 8 one stays; rows without words or id stay
        assert 1 in ids and 2 not in ids and 8 not in ids and {3, 4, 5, None} <= set(ids) and all(100 + i in ids for i in range(12))
    if name == "mixing sources to target weights":  # no word, no copy; else at most three
        assert not {3, 4, 5} & set(ids) and max(ids.count(i) for i in set(ids) - {2}) <= 3 and ids.count(2) <= 6


@pytest.mark.parametrize("k", range(5))
def test_stage_on_an_empty_table(spark, k):
    docs = empty_docs(spark).withColumn("size", F.lit("own"))
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.collect() == [] and (k == 4 or out.dtypes == docs.dtypes)
