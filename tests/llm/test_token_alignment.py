"""Alignment of tokenizers against whole texts, `tokenizers` itself and all pairs of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from concordat.llm import token_alignment
from concordat.llm.catalog import tokenizer_files
from tests.llm.helpers import DOCS, empty_docs, odd_docs

FILES = {**tokenizer_files(), "pieces": P.path("piece_bpe_32k.model")}


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return [(i, bytes(back[c] for c in a.id_to_token(i))) for i in ids_a], [(i, piece(i)) for i in ids_b]

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def plain(texts, tokens):
    """What the contract says, by all pairs of byte ranges."""
    each, holders = [], Counter()
    for t in texts:
        a, b = tokens(t or "")
        if not t or b"".join(x for _, x in a) != (" " + t).encode() or b"".join(x for _, x in b) != (" " + t).encode():
            each.append(None)
            continue
        a, b = spans(a), spans(b)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, start = [], 0
        for e in ends:
            own = lambda side: ",".join(str(i) for i, s, f in side if start <= s and f <= e)  # noqa: B023, E731
            parts.append(f"{own(a)}|{own(b)}")
            start = e
        each.append((len(a), len(b), len(ends), links, ";".join(parts)))
        holders.update(set(links))
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    for x in each:
        if x is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            links = x[3]
            yield (*x[:3], len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), x[4])


def strange(seed: int) -> str:
    r = random.Random(seed)
    bits = ["the", "Unbelievable", "tokenisation", "1234567", "3.14", "don't", "ﬁn", "x²", "日本語の文", "мир", "é", "é", "😀👍🏽", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "aaaaaaaaaaaaaaaa", "_", "--", "\x00", "\x1c", "\x85", "ñandú"]
    gaps = [" ", " ", " ", "  ", "   ", "\n", "\n ", " \n", "\t", "\r\n", " ", "  ", "　", "　 ", "  ", "  ", "", "\x1f ", "\x85 "]
    out = "".join(r.choice(bits) + r.choice(gaps) for _ in range(r.randrange(1, 40)))
    return r.choice(("", " ", "  ", "\n")) + out + r.choice(("", " ", "\n")) + ("▁ x" if r.random() < 0.1 else "")


def test_units_have_the_tokens_of_whole_texts(both):
    tools = token_alignment.Aligner(**FILES)
    assert tools.cuts
    texts = [strange(s) for s in range(600)]
    found = token_alignment.Aligned(tools, pa.array(texts))
    want = list(plain(texts, both))
    got = [(int(found.n_a[k]), int(found.n_b[k]), int(found.n_groups[k]), int(found.n_links[k]), str(found.groups(k), "utf-8") if found.valid[k] else "") for k in range(len(texts))]
    assert got == [(*w[:4], w[6]) for w in want]
    assert 0 < sum(not v for v in found.valid) < 120


def test_overlaps_against_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(1, 60))
        a, b = (np.unique(np.append(r.integers(1, n + 1, int(r.integers(1, 20))), n)) for _ in range(2))
        first, last = token_alignment.overlaps(a, b)
        s, t = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
        for i in range(len(a)):
            assert [j for j in range(len(b)) if s[i] < b[j] and t[j] < a[i]] == list(range(first[i], last[i] + 1))


def test_small_numbers_round_trip():
    x = [np.array([], np.int64), np.arange(9)[::-1], np.array([0, 2**31, 5])]
    assert all((p == q).all() and len(p) == len(q) for p, q in zip(x, token_alignment.unpacked(token_alignment.packed(*x), 3)))


def digests(rows):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


def expected(rows, tokens):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return Counter((i, *w[:6], sha(w[6])) for i, w in zip([r[0] for r in rows], plain([r[1] for r in rows], tokens)))


def test_counts_over_blocks(spark, both):
    words = [strange(s) for s in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*words, *words[:20], *["the same words"] * 30, None, "", " ", "▁", "one ▁ two"])]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    for size in (300, 4_000_000):
        assert digests(token_alignment.align(d, FILES, size).collect()) == expected(rows, both)
    texts = {r.doc_id: r.groups for r in token_alignment.groups(d, FILES).collect()}
    assert [texts[k] for k in range(len(rows))] == [w[6] for w in plain([r[1] for r in rows], both)]


@pytest.mark.parametrize("extra", (False, True))
def test_odd_inputs(spark, both, extra):
    d = odd_docs(spark, extra)
    for name in ("block", "pair", "docs", "at", "pairs") if extra else ():
        d = d.withColumn(name, d["source"])
    short = d.where("length(text) < 100000 or text is null")
    rows = [tuple(r) for r in short.select("doc_id", "text").collect()]
    assert digests(token_alignment.align(short, FILES).collect()) == expected(rows, both)
    assert token_alignment.align(d, FILES).count() == d.count()
    assert token_alignment.align(empty_docs(spark), FILES).collect() == []


def test_very_long_units(both):
    tools = token_alignment.Aligner(**FILES)
    for t in ("a" * 30000, " " * 30000, "ab1 " * 20000, "\n" * 30000):
        found = token_alignment.Aligned(tools, pa.array([t]))
        assert int(found.n_a[0]) == len(both(t)[0]) and int(found.n_b[0]) == len(both(t)[1])
