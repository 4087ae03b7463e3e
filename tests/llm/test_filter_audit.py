"""Filter audit against a plain walk of every document through every order."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from concordat.llm import filter_audit
from tests.llm.helpers import DOCS, empty_docs, odd_docs


def fails_of(rows):
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(r["doc_id"], least.get(r["text"] or "", r["doc_id"]))
    for r in rows:
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield r, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(set(t) & set("#$%&*|")), "E": r["doc_id"] is not None and r["doc_id"] > least[t],
        }


def walk(rows, good, toxic):
    out, shapley = Counter(), Counter()
    parts = {r["lang"] or "" for r in rows}
    for r, fails in fails_of(rows):
        part, alive_everywhere = r["lang"] or "", None
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, c in enumerate(order, 1):
                key = (part, order, step)
                if fails[c] and gone:
                    out[key, "redundant"] += 1
                if fails[c] and not gone:
                    gone = True
                    out[key, "removed"] += 1
                    out[key, "good_lost"] += r["doc_id"] in good
                    out[key, "toxic_lost"] += r["doc_id"] in toxic
                    shapley[part, c] += 1
                out[key, "kept"] += not gone
                out[key, "unique_fails"] += fails[c] and sum(fails.values()) == 1
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, k): (*[out[(p, o, k), n] for n in names], shapley[p, o[k - 1]]) for p in parts for o in map("".join, permutations("ABCDE")) for k in range(1, 6)}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def made(seed: int, n: int):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [r.choice("abcdefgh") * r.randrange(1, 5) + (str(r.randrange(500)) if r.random() < 0.6 else "") for _ in range(r.choice((0, 3, 199, 200, 201, 400)))]
        t = r.choice((" ", "\n", "\t ")).join(words)
        t = t.upper() if r.random() < 0.2 else t
        texts.append(t + r.choice(("", "", " #", " 5%", "É")))
    texts += r.choices(texts, k=n) + [None, "", ""]
    return [(r.choice([None, *range(60)]) if r.random() < 0.3 else 100 + i, t, r.choice(("en", "de", None)), "s", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("extra", (False, True))
def test_odd_inputs_as_walked(spark, extra):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 1), (7, 2, 3)], "doc_id long, quality int, toxic int")
    d = odd_docs(spark, extra)
    for name in ("n", "mask", "copy_key", "part", "good", "label_id", "key") if extra else ():
        d = d.withColumn(name, d["source"])
    rows = [r.asDict() for r in d.select("doc_id", "text", "lang").collect()]
    assert got(filter_audit.audit(d, labels)) == walk(rows, {1, 3}, {1, 3})


def test_generated_tables_as_walked(spark):
    for seed in range(2):
        rows = made(seed, 40)
        d = spark.createDataFrame(rows, DOCS)
        labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 140)], "doc_id long, quality int, toxic int")
        plain = [dict(zip(("doc_id", "text", "lang"), r)) for r in rows]
        assert got(filter_audit.audit(d, labels)) == walk(plain, {i for i in range(140) if i % 2}, {i for i in range(140) if i % 3 == 0})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty_docs(spark), none).collect() == []
    assert len(filter_audit.audit(odd_docs(spark), none).collect()) % 600 == 0


def test_matrices_are_consistent():
    m = filter_audit.outcomes()
    assert all(v.shape == (32, 600) for v in m.values())
    removed = m["removed"].reshape(32, 120, 5)
    assert (removed.sum(2)[1:] == 1).all() and (removed.sum(2)[0] == 0).all()
    assert (m["kept"].reshape(32, 120, 5)[:, :, -1] == (np.arange(32) == 0)[:, None]).all()
