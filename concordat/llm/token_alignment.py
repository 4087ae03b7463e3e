"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked id pairs.

A text's tokens under A and under B tile the same bytes. The B tokens are a static index of
intervals, sorted by their ends; for each A token two bisections give the first and the last
B token that it overlaps. Where the last one ends with the A token no token spans the gap,
and a group of tokens ends there.

Texts are cut before every space that follows something other than white space. No
pre-token of A reaches over such a place (its pattern matches white space only from its
start on), and no piece of B does, which is checked when the model is loaded (else texts
stay whole). So a unit's tokens are those of the text, a group lies in one unit, and each
different unit of a block is encoded and aligned once.

Blocks of texts (``BLOCK_BYTES``, or one longer text) are written to the shared folder with
their distinct id pairs. A pair's documents are counted over all blocks after a partial sum
in each block; the counts come back once for each block and pair, not for each document.
A pair that every block holds is a key of as many rows as there are blocks; both sides of
that join are tables, so adaptive execution can split it. Only the highest count of each A
id is broadcast: at most one row for each entry of A's vocabulary.

Nulls: a null or empty text has no tokens: zeros and an empty string. So has a text whose
bytes B does not give back (it holds U+2581). A null doc_id is carried through. Rows that
repeat count as documents each for itself. Texts of any length are read whole. An empty table gives no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from concordat.llm.shared import slices, stored, strings

BLOCK_BYTES = 1_000_000
#: An id pair is one long: the A id above these bits, the B id in them.
B_BITS = 24


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last interval of B that each interval of A overlaps; both tile the same line, given by their ends."""
    a_start = np.concatenate([[0], a_end[:-1]])
    b_start = np.concatenate([[0], b_end[:-1]])
    return np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left") - 1


def ranges_of(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n of them, one after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def totals(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of lengths n."""
    upto = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    end = np.cumsum(n)
    return upto[end] - upto[end - n]


def unit_starts(raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places of ``raw`` (UTF-8) where a unit starts: texts, and spaces after anything that cannot be white space."""
    white = (raw <= 0x20) & ((raw == 0x20) | ((raw >= 9) & (raw <= 13)) | (raw >= 0x1C))
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), raw[: max(len(raw) - k, 0)]])[: len(raw)] for k in (1, 2, 3))
    # Leading bytes of all white space beyond ASCII, and of U+2581.
    rare = (one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
    start = (raw == 0x20) & ~np.concatenate([[True], white[:-1]])[: len(raw)] & ~rare
    start[text_starts] = True
    return np.flatnonzero(start)


class PlainEncoder:
    """Ids of the byte-level BPE with special tokens' strings as plain text, as ``tokenizers`` gives them with ``encode_special_tokens``."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import base64
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.vocabulary, self.slow = vocabulary, None
        self.bytes = [b""] * (max(table.values()) + 1)
        for k, v in table.items():
            self.bytes[v] = k

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # of the native code, on extreme runs
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class Aligner:
    """Both tokenizers, and what their ids are as bytes and as decimals."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str, pieces: str):
        import sentencepiece

        self.a = PlainEncoder(vocabulary, ranks, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_bytes = self.a.bytes
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        ids = [str(i) for i in range(max(len(names), len(self.a_bytes)))]
        self.decimals, self.ids = pa.array([i + s for s in ",|;" for i in ids], pa.large_binary()), len(ids)

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Different units of space + text, the unit of each occurrence, occurrences by text."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
        _, off, data = spaced.buffers()
        off = np.frombuffer(off, np.int64, len(spaced) + 1, spaced.offset * 8)
        raw = np.frombuffer(data, np.uint8)[: off[-1]]
        start = unit_starts(raw, off[:-1]) if self.cuts else off[:-1]
        n = np.diff(np.searchsorted(start, off))
        bounds = np.concatenate([start, off[-1:]]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), data).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), n

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; a unit that one of them does not give back has none."""
        a = [self.a(u) for u in units]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        b = [[self.space] if u == " " else x for u, x in zip(units, b, strict=True)]
        same = [bytes().join(map(self.a_bytes.__getitem__, x)) == u.encode() == bytes().join(map(self.b_bytes.__getitem__, y)) for u, x, y in zip(units, a, b, strict=True)]
        return [x if s else [] for x, s in zip(a, same, strict=True)], [y if s else [] for y, s in zip(b, same, strict=True)]


@cache
def loaded(**files: str) -> Aligner:
    """Once in a worker's life."""
    return Aligner(**files)


class Aligned:
    """A block of texts: by text the counts of tokens, groups and links, its groups in writing, and its units; by unit its links."""

    def __init__(self, tools: Aligner, texts: pa.Array):
        units, self.unit, self.units = tools.units(texts)
        a, b = tools.tokens(units.to_pylist())
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
        a_end, b_end = np.cumsum(tools.a_size[a]), np.cumsum(tools.b_size[b])
        first, last = overlaps(a_end, b_end)
        wide = last - first + 1
        a_last = b_end[last] == a_end
        b_last = np.zeros(len(b), bool)
        b_last[last[a_last]] = True
        pair = np.repeat(a << B_BITS, wide) | b[ranges_of(first, wide)]
        self.pairs, self.link = np.unique(pair, return_inverse=True)
        self.links = totals(wide, n_a)
        n_groups = totals(a_last, n_a)

        # Where each token stands among all: behind those of A up to its group and those of B up to the group before, or its own.
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        up_a, up_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n_groups.sum()))]) for g in (a_group, b_group))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + up_b[a_group]] = a + np.where(a_last, tools.ids, 0)
        code[np.arange(len(b)) + up_a[b_group + 1]] = b + np.where(b_last, 2 * tools.ids, 0)
        size = totals(pc.binary_length(tools.decimals).to_numpy()[code], n_a + n_b)
        written = tools.decimals.take(pa.array(code)).buffers()[2]
        end = np.concatenate([[0], np.cumsum(size)])
        by_unit = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(end), written or pa.py_buffer(b"")])
        whole = by_unit.take(pa.array(self.unit)).buffers()[2]

        # A text is out if it is empty or one of its units is.
        given = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        self.valid = given & (totals(n_a[self.unit] == 0, self.units) == 0)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.where(self.valid, totals(x[self.unit], self.units), 0) for x in (n_a, n_b, n_groups, self.links))
        text_end = np.cumsum(totals(size[self.unit], self.units))
        self.places = list(zip(np.concatenate([[0], text_end[:-1]]).tolist(), text_end.tolist(), strict=True)) if len(text_end) else []
        self.whole = memoryview(whole or b"")

    def groups(self, k: int) -> memoryview:
        """``a1,a2|b1;a3|b2,b3`` of a text with tokens."""
        at, end = self.places[k]
        return self.whole[at : end - 1]

    def digests(self) -> list[str]:
        return [hashlib.sha256(self.groups(k)).hexdigest() if v else "" for k, v in enumerate(self.valid.tolist())]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold each pair; different units of each text, how many, and how often each."""
        text = np.repeat(np.arange(len(self.units)), np.where(self.valid, self.units, 0))
        unit = self.unit[np.repeat(self.valid, self.units)]
        n = max(len(self.links), 1)
        both, times = np.unique(text * n + unit, return_counts=True)
        text, unit = both // n, both % n
        wide = self.links[unit]
        link = self.link[ranges_of((np.cumsum(self.links) - self.links)[unit], wide)]
        p = max(len(self.pairs), 1)
        seen = np.unique(np.repeat(text, wide) * p + link) % p
        return np.bincount(seen, minlength=len(self.pairs)), np.bincount(text, minlength=len(self.units)), unit, times


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers as compressed 32-bit differences, with their lengths."""
    head = np.array([len(x) for x in arrays], np.uint32).tobytes()
    body = b"".join(np.ascontiguousarray(np.diff(x.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 4 * n
    for size in np.frombuffer(raw, np.uint32, n).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32).astype(np.int64))
        at += 4 * size
    return out


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def groups(docs: DataFrame, files: dict[str, str]) -> DataFrame:
    """doc_id, the four counts and the groups of each document's tokens in writing."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = loaded(**files)
        for b in slices(batches, "text"):
            x = Aligned(tools, strings(b, "text"))
            texts = [str(x.groups(k), "ascii") if v else "" for k, v in enumerate(x.valid.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(getattr(x, c)) for c in COUNTS], pa.array(texts, pa.string())], ["doc_id", *COUNTS, "groups"])

    return d.mapInArrow(write, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups string")


def blocks(docs: DataFrame, files: dict[str, str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: its pairs with the number of its documents that hold each, and by document what ``align`` gives."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = loaded(**files)
        task = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches, "text", block_bytes)):
            x = Aligned(tools, strings(b, "text"))
            holders, different, unit, times = x.held()
            row = lambda values, kind=None: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            out = {
                "block": pa.array([task + k]), "pairs": row(x.pairs), "holders": row(holders.astype(np.int32)), "doc_ids": row(b.column(0)), **{c: row(getattr(x, c)) for c in COUNTS},
                "groups_sha256": row(x.digests(), pa.string()), "uses": pa.array([packed(different, unit, times, x.links, x.link)], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    counts = ", ".join(f"{c} array<long>" for c in COUNTS)
    return d.mapInArrow(encode, f"block long, pairs array<long>, holders array<int>, doc_ids array<{kind}>, {counts}, groups_sha256 array<string>, uses binary")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs): the documents of all blocks that hold each pair linked."""
    each = found.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.holders").cast("long").alias("n"))
    return each.groupBy("pair").agg(F.sum("n").alias("docs"))


def align(docs: DataFrame, files: dict[str, str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of (doc_id, text)."""
    found = stored(blocks(docs, files, block_bytes))
    kind = found.schema["doc_ids"].dataType.elementType.simpleString()
    counted = stored(pair_counts(found))
    a = F.shiftrightunsigned("pair", B_BITS)
    most = counted.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    valued = counted.join(F.broadcast(most), a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    wanted = found.select("block", F.posexplode("pairs").alias("at", "wanted"))
    back = wanted.join(valued, F.col("wanted") == F.col("pair")).groupBy("block").agg(F.collect_list(F.struct("at", "docs", "best")).alias("cells"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(i)[k] for i, n in enumerate(b.schema.names)}
                different, unit, times, links, link = unpacked(row["uses"].as_py(), 5)
                docs_of, best_of = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
                if row["cells"].is_valid:
                    cells = row["cells"].values
                    at = pc.struct_field(cells, "at").to_numpy()
                    docs_of[at] = pc.struct_field(cells, "docs").to_numpy()
                    best_of[at] = pc.struct_field(cells, "best").to_numpy(zero_copy_only=False)
                n_best, count_sum = (pa.array(totals(times * totals(v[link], links)[unit], different)) for v in (best_of, docs_of))
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, *[row[c].values for c in COUNTS], n_best, count_sum, row["groups_sha256"].values], names)

    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'n_best', 'count_sum'))}, groups_sha256 string"
    whole = found.join(back.withColumnRenamed("block", "its"), F.col("block") == F.col("its"), "left").drop("its", "holders")
    return whole.mapInArrow(score, schema)
