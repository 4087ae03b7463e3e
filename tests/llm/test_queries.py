"""The registered queries of the operators: the contracts' columns, and SQL where there is some."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from concordat.llm import catalog

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_tokens log_prob", 2: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 3: "doc_id n_assign n_access n_hex base_sha256 spans", 4: "page_id host path rule verdict",
    5: "vec_id n_links component_id kept", 6: "doc_id held_out score predicted", 7: "doc_id n_lines n_dropped text_sha256", 8: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 9: "doc_id class_id kept", 10: "doc_id size source_size target taken",
    11: "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", 12: "page_id url text n_chars", 13: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_columns_and_rows(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    n = int(name[2:].split("_")[0])
    assert set(COLUMNS[n].split()) <= set(out.columns)
    rows = out.count()
    table = {4: "pages", 12: "pages", 5: "embeddings"}.get(n, "documents")
    assert rows >= 1 and (n in (8, 11) or rows == spark.read.parquet(f"{SF}/{table}.parquet").count())


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    cur = c.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = Counter(tuple(r) for r in cur.fetchall())
    assert Counter(tuple(r[k] for k in names) for r in catalog.QUERIES[name](spark, SF).collect()) == want
