"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from concordat.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
