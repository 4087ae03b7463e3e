"""Groups beyond the size of one block give what one unsplit group gives."""

import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from concordat.llm import line_templates, order_minhash
from tests.llm.helpers import DOCS, prose


def plain_grow(lines, agreement):
    """grow() against every template, without an index."""
    templates, out = [], []
    for line in lines:
        same = [sum(a == b for a, b in zip(t, line)) for t in templates]
        g = max(range(len(same)), key=lambda i: (same[i], -i), default=-1)
        if g >= 0 and same[g] >= agreement * len(line):
            templates[g] = [a if a == b else None for a, b in zip(templates[g], line)]
        else:
            g = len(templates)
            templates.append(line)
        out.append(g)
    return out, [[line_templates.WILD if a is None else a for a in t] for t in templates]


def test_grow_by_keys_is_grow_by_all_templates():
    r = random.Random(5)
    for n in (1, 3, 4, 5, 7, 10, 16, 23, 61):
        for agreement in (0.8, 0.5, 0.95, 1.0):
            base = [[f"w{r.randrange(60)}" for _ in range(n)] for _ in range(6)]
            lines = []
            for _ in range(150):
                line = list(r.choice(base))
                for p in r.sample(range(n), r.randrange(max(n // 3, 1) + 1)):
                    line[p] = r.choice(["red", "blue", line_templates.WILD, f"x{r.randrange(9)}"])
                lines.append(line)
            assert line_templates.grow(lines, agreement) == plain_grow(lines, agreement)


def test_large_leaf_is_parsed_as_one(spark):
    """A leaf of 4,000 lines: families of few and of many variants, one variant a document, among lines of their own."""
    r, rows = random.Random(6), []
    family = [prose(10 + f, 9).split() for f in range(60)]
    for i in range(4000):
        if i % 4:
            words = prose(1000 + i, 9).split()
        else:
            f = family[0] if i % 8 else family[1 + i // 8 % 59]
            words = list(f)
            words[r.randrange(9)] = f"v{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"
        rows.append((i, " ".join(["all", "lines", "begin", *words]), "en", "s", 0))
    order = sorted(t.split(" ") for _, t, *_ in rows)
    group, templates = plain_grow([x for x in order], 0.8)
    of = {" ".join(line): " ".join(templates[g]) for line, g in zip(order, group)}
    docs = {}
    for i, t, *_ in rows:
        docs.setdefault(of[t], []).append(i)
    want = {i for ids in docs.values() if len(ids) >= 3 for i in ids if i != min(ids)}
    assert len(order) > line_templates.BLOCK and len(want) > 300
    out = line_templates.dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert {x.doc_id for x in out if x.n_dropped} == want


def test_variant_of_a_passed_member_only(spark):
    """One text is similar to a member that matched the leader, and to no other text of the bucket; small blocks."""
    from unittest.mock import patch

    import numpy as np

    base = prose(40, 300).split()
    edited = lambda words, at: [f"new{p}x{at[0]}" if p in at else w for p, w in enumerate(words)]
    rows = [(i, " ".join(edited(base, [20 + i % 150, 20 + (7 * i + 3) % 150])), "en", "s", 0) for i in range(300)]
    near = edited(base, range(200, 250))
    edge = edited(near, range(250, 300))
    rows += [(1000, " ".join(near), "en", "s", 0), (1001, " ".join(edge), "en", "s", 0)]
    rows += [(2000 + i, prose(900 + i, 300), "en", "s", 0) for i in range(40)]  # in the bucket, but like nothing
    d = spark.createDataFrame(rows, DOCS)
    seq = dict(zip([r[0] for r in rows], order_minhash.sequences(pa.array([r[1] for r in rows]))))
    fits = [i for i in seq if i != 1001 and order_minhash.similar(seq[i], seq[1001], 0.8)]
    assert fits == [1000]

    def one_bucket(texts):
        n = np.array([len(t.split()) for t in texts.to_pylist()], np.int64)
        own = np.array([zlib.crc32(t.encode()) for t in texts.to_pylist()], np.uint64)
        out = own[:, None] * np.uint64(100) + np.arange(order_minhash.SKETCHES, dtype=np.uint64)
        out[:, 0] = 7
        return n, out

    with patch.object(order_minhash, "sketches", one_bucket), patch.object(order_minhash, "BLOCK", 50):
        out = {x.doc_id: x.class_id for x in order_minhash.classes(d).collect()}
    assert {i for i, c in out.items() if c == 0} == set(range(300)) | {1000, 1001}
    assert all(out[i] == i for i in range(2000, 2040))


def test_vectors_beyond_one_block(spark):
    """Leaves, visits, blocks of a leaf and links across them, against all pairs."""
    from unittest.mock import patch

    import numpy as np

    from concordat.llm import embeddings

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) * np.linspace(2, 0.5, 16)
    x[700:900] = x[3] + rng.normal(size=(200, 16)) * 0.15  # a dense group, larger than a block
    x[900:1200] = x[rng.integers(0, 700, 300)] + rng.normal(size=(300, 16)) * 0.12
    x[1200:1210] = x[5] * 3
    label = np.where(np.arange(1500) % 3 > 0, 1, 2)
    rows = [(int(i), x[i].tolist(), int(label[i])) for i in range(1500)] + [(2000, rng.normal(size=1500).tolist(), 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (label[:, None] == label) & ~np.eye(1500, dtype=bool)
    comp = np.arange(1500)
    for i, j in zip(*np.nonzero(linked)):
        comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
    assert linked.sum() > 2000
    for size in (30, 100, 10_000):
        out = {r.vec_id: r for r in embeddings.near_duplicates(d.where("vec_id < 2000"), block=lambda n, size=size: size).collect()}
        assert [out[i].n_links for i in range(1500)] == linked.sum(axis=1).tolist()
        assert [out[i].component_id for i in range(1500)] == comp.tolist()
    with patch.object(embeddings, "TURNED", 8):
        long_ = embeddings.near_duplicates(d.where("vec_id = 2000 or vec_id < 300")).collect()
        assert {r.vec_id: r.n_links for r in long_} == {2000: 0} | {i: int(linked[i, :300].sum()) for i in range(300)}
