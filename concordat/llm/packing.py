"""Bounded-space online packing of token sequences.

Each task keeps a fixed number of open windows. A document longer than a window is cut
into full windows first; its tail goes to the open window it fits best. When none fits,
the fullest is topped up with the head of the tail if its gap is worth a cut, then
emitted, and the tail opens a window. What is open at the end of a task is carried, with
its ids, to a merge: the leftovers of ``MERGE`` tasks are packed again in one group, and
the group's own last windows are filled up in turn, so one partial window remains. That
one is cut into powers of two, which need no padding.

Memory is that of the open windows and one slice of texts, whatever the input. A task's
pieces depend only on its own rows in their order, so a lost task comes out the same.
The merge carries at most ``open_windows`` windows from each task.

Nulls: a null text is an empty one and gives the single end id; a null doc_id is carried
through. Rows that repeat are packed each for itself. An empty table gives no pieces.
Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from concordat.llm.shared import cut, slices, strings

MERGE = 16
TASK_SHIFT = 1 << 36


class Encoder:
    """Ids of the byte-level BPE in a ``tokenizers`` file, with ``add_special_tokens=False``.

    The ids are those of ``tokenizers``. Where the same vocabulary is there as ranks, they are
    found with ``tiktoken``, which takes a seventh of the time on one core; texts that hold a
    special token's string, which the former maps to one id, stay with ``tokenizers``.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(vocabulary), None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the native code on extreme runs is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


class Packer:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, width: int, most_open: int, least_cut: int):
        self.width, self.most_open, self.least_cut = width, most_open, least_cut
        self.open: list[tuple[int, list]] = []

    def put(self, piece: tuple) -> Iterator[list]:
        doc, at, ids, total = piece
        while len(ids) >= self.width:
            yield [(doc, at, ids[: self.width], total)]
            at, ids = at + self.width, ids[self.width :]
        if len(ids) == 0:
            return
        n, best = len(ids), -1
        for i, (used, _) in enumerate(self.open):
            if used + n <= self.width and (best < 0 or used > self.open[best][0]):
                best = i
        if best < 0 and len(self.open) == self.most_open:
            full = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(full)
            gap = self.width - used
            if gap >= self.least_cut:
                pieces.append((doc, at, ids[:gap], total))
                at, ids = at + gap, ids[gap:]
            yield pieces
            n = len(ids)
        if best < 0:
            self.open.append((n, [(doc, at, ids, total)]))
            return
        used, pieces = self.open[best]
        pieces.append((doc, at, ids, total))
        if used + n == self.width:
            self.open.pop(best)
            yield pieces
        else:
            self.open[best] = (used + n, pieces)

    def fill_up(self) -> Iterator[list]:
        """All that is open, in turn, as full windows; the rest in powers of two."""
        window, room = [], self.width
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for doc, at, ids, total in pieces:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    window.append((doc, at, part, total))
                    at, room = at + len(part), room - len(part)
                    if room == 0:
                        yield window
                        window, room = [], self.width
        left, size = self.width - room, 1 << (self.width.bit_length() - 1)
        while left:
            if left & size:
                out, need = [], size
                while need:
                    doc, at, ids, total = window.pop(0)
                    out.append((doc, at, ids[:need], total))
                    if len(ids) > need:
                        window.insert(0, (doc, at + need, ids[need:], total))
                    need -= len(out[-1][2])
                yield out
                left -= size
            size >>= 1
        self.open = []


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def schema_of(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.BinaryType()), T.StructField("open", T.BooleanType())]
    )


class Rows:
    """Collects pieces into Arrow batches."""

    def __init__(self, schema: pa.Schema, keep_ids: bool):
        self.schema, self.keep_ids = schema, keep_ids
        self.cols: list[list] = [[] for _ in schema]

    def add(self, sequence: int, pieces: list, open_: bool = False) -> None:
        offset = 0
        for doc, at, ids, total in pieces:
            row = (doc, at, len(ids), crc(ids), total, sequence, offset, ids.astype("<u4").tobytes() if open_ or self.keep_ids else None, open_)
            for c, v in zip(self.cols, row, strict=True):
                c.append(v)
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema, strict=True)], schema=self.schema)
        self.cols = [[] for _ in self.schema]
        return out


def pack(
    docs: DataFrame, vocabulary: str, *, ranks: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id",
    width: int = 1024, end_id: int = 0, open_windows: int = 32, least_cut: int = 16, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A sequence of fewer than ``width`` ids is to be padded up to it, unless its length is a
    power of two. Gaps under ``least_cut`` are padded rather than filled with a cut.
    """
    spark = docs.sparkSession
    schema = schema_of(docs.schema[doc_id].dataType)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        encode = Encoder(vocabulary, ranks, pattern)
        packer, rows = Packer(width, open_windows, least_cut), Rows(to_arrow_schema(schema), keep_ids)
        sequence = TaskContext.get().partitionId() * TASK_SHIFT
        for b in slices(batches, "text"):
            for doc, s in zip(b.column(0).to_pylist(), strings(b, "text").to_pylist(), strict=True):
                ids = np.array([*encode(s), end_id], np.uint32)
                for done in packer.put((doc, 0, ids, len(ids))):
                    rows.add(sequence, done)
                    sequence += 1
            yield rows.batch()
        for _, pieces in packer.open:
            rows.add(sequence, pieces, True)
            sequence += 1
        yield rows.batch()

    two = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = cut(two.mapInArrow(first, schema))

    def again(key: tuple, t: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        packer, rows = Packer(width, open_windows, least_cut), Rows(to_arrow_schema(schema), keep_ids)
        # Its ids lie in the upper half of the first task's range, which that task cannot reach.
        sequence = key[0].as_py() * MERGE * TASK_SHIFT + TASK_SHIFT // 2
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        put = zip(t["doc_id"].to_pylist(), t["start"].to_pylist(), t["ids"].to_pylist(), t["doc_tokens"].to_pylist(), strict=True)
        for doc, at, ids, total in put:
            for done in packer.put((doc, at, np.frombuffer(ids, "<u4"), total)):
                rows.add(sequence, done)
                sequence += 1
        for done in packer.fill_up():
            rows.add(sequence, done)
            sequence += 1
        return pa.Table.from_batches([rows.batch()])

    group = F.floor(F.col("sequence_id") / F.lit(MERGE * TASK_SHIFT)).alias("group")
    merged = packed.where("open").groupBy(group).applyInArrow(again, schema)
    out = packed.where("not open").unionByName(merged).drop("open")
    return out if keep_ids else out.drop("ids")


def decode(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))
