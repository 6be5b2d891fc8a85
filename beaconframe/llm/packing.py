"""Harmonic packing of tokenized documents into sequences.

A document is cut into full sequences, then into reciprocal parts of the capacity (a half,
a quarter, ... down to a sixteenth), and what is left over stays whole.  A piece belongs to
the class k = capacity // length, and a bin of class k holds exactly k pieces: the parts
fill their bins without padding, and left-overs to 16/17 at least.

Workers fill the bins of their classes on their own while they read, and pass on only the
pieces of bins that did not fill (less than one bin for each class).  Those are filled in
the same way by about the square root of the number of workers, and the rest of that,
again under one bin for each class and worker, by one task, which ends with first-fit
decreasing.  So only one sequence of the whole corpus is much shorter than the capacity.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, column, materialize

_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
_SPACE = [("worker", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


#: Runs of white space from this length on are left to the .json tokenizer: a backtracking pattern needs a stack as deep as the run.
_LONG_SPACE = re.compile(r"\s{10000}")


def load_encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> token ids as uint32 of a tokenizers .json file.

    ``ranks`` names the same vocabulary as a .tiktoken file, which with its ``pattern`` is
    several times as fast.  It takes the texts that it can; the .json file takes the others,
    which are those with very long runs of white space.  The string of the special token in
    a text is that token, in both.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return whole
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=known, special_tokens={"<|endoftext|>": len(known)})

    def encode(text: str) -> np.ndarray:
        if len(text) >= 10_000 and _LONG_SPACE.search(text):
            return whole(text)
        return coder.encode_to_numpy(text, allowed_special="all")

    return encode


def cut_lengths(tokens: int, capacity: int, parts: int = 16) -> list[int]:
    """Lengths of a document's pieces: full sequences, reciprocal parts, and the rest whole."""
    out = [capacity] * (tokens // capacity)
    left, k = tokens % capacity, 2
    while k <= parts and left:
        if left >= capacity // k:
            out.append(capacity // k)
            left -= capacity // k
        k *= 2
    while left >= capacity // parts:  # capacities that are no power of two leave more than one part
        out.append(capacity // parts)
        left -= capacity // parts
    return [*out, left] if left else out


class Bins:
    """The bins that one worker fills: one open bin for each class of pieces."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, length: int) -> Iterator[tuple]:
        """The pieces of a bin that is full now, with sequence and offset."""
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((piece, length))
        if len(held) == k:
            del self.open[k]
            yield from self.close(held)

    def close(self, held: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece, length in held:
            yield piece, self.next_id, at
            at += length
        self.next_id += 1

    def rest(self) -> list[tuple]:
        return [x for held in self.open.values() for x in held]


def first_fit(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Bins of (piece, length), by first fit of decreasing lengths."""
    bins: list[list[tuple]] = []
    room: list[int] = []
    first: dict[int, int] = {}  # bins before it have no room for the length or more
    for piece, length in sorted(pieces, key=lambda x: -x[1]):
        at = first.get(length, 0)
        while at < len(bins) and room[at] < length:
            at += 1
        first[length] = at
        if at == len(bins):
            bins.append([])
            room.append(capacity)
        bins[at].append((piece, length))
        room[at] -= length
    return bins


def pack(
    docs: DataFrame,
    *,
    vocabulary: str,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then ``end_id``.  start is the number of its ids before
    the piece, offset the number of ids before it in its sequence.  With ``with_ids`` the
    piece's ids follow as an array.  ``vocabulary`` is a tokenizers .json file; ``ranks`` and
    ``pattern`` may give the same vocabulary in its faster form.

    Null and empty texts are the one id ``end_id``.  Null ids and repeated rows are packed
    like any other row, and an empty table gives no rows; other columns are not read.
    """
    ids_kind = [("ids", pa.list_(pa.int32()))] if with_ids else []
    names = ["id", *(n for n, _ in _FIELDS), *(n for n, _ in ids_kind), *(n for n, _ in _SPACE)]
    kinds = [k for _, k in (*_FIELDS, *ids_kind, *_SPACE)]
    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_kind}, start long, length long, ids_crc32 long, doc_tokens long, {'ids array<int>, ' if with_ids else ''}worker long, sequence_id long, offset long"

    def out(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [id_type, *kinds], strict=True)], names=names)

    def tokenized(batch: pa.RecordBatch, encode: Callable) -> Iterator[tuple[tuple, int]]:
        for doc, text in zip(column(batch, id_col).to_pylist(), column(batch, text_col).to_pylist(), strict=True):
            ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end_id)).astype("<u4")
            at, raw = 0, memoryview(ids).cast("B")
            for length in cut_lengths(len(ids), capacity):
                piece = (doc, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), len(ids))
                yield (*piece, ids[at : at + length].astype(np.int32)) if with_ids else piece, length
                at += length

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = load_encoder(vocabulary, ranks, pattern), TaskContext.get().partitionId()
        bins, kind = Bins(capacity, worker << 36), None
        for batch in batches(parts):
            kind = column(batch, id_col).type
            full = [(*p, worker, s, o) for piece, n in tokenized(batch, encode) for p, s, o in bins.add(piece, n)]
            yield out(full, kind)
        if kind is not None:
            yield out([(*p, worker, None, None) for p, _ in bins.rest()], kind)

    def refill(level: int) -> Callable:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker = TaskContext.get().partitionId()
            bins, kind = Bins(capacity, (level << 60) + (worker << 36)), None
            for batch in batches(parts, 4096):
                kind = column(batch, "id").type
                rows = list(zip(*(column(batch, n).to_pylist() for n in names[:-3]), strict=True))
                yield out([(*p, worker, s, o) for piece in rows for p, s, o in bins.add(piece, piece[2])], kind)
            if kind is not None and level == 1:
                yield out([(*p, worker, None, None) for p, _ in bins.rest()], kind)
            elif kind is not None:
                last = first_fit(bins.rest(), capacity)
                yield out([(*p, worker, s, o) for held in last for p, s, o in bins.close(held)], kind)

        return run

    order = ("length", "id", "start", "ids_crc32")
    level0 = materialize(docs.select(id_col, text_col).mapInArrow(read, schema), "packed")
    workers = (level0.agg(F.max("worker")).first()[0] or 0) + 1
    groups = math.isqrt(workers - 1) + 1
    open0 = level0.where("sequence_id IS NULL").withColumn("group", F.pmod("worker", F.lit(groups)))
    level1 = open0.repartition(groups, "group").drop("group").sortWithinPartitions(*order).mapInArrow(refill(1), schema)
    level1 = materialize(level1, "packed-again")
    level2 = level1.where("sequence_id IS NULL").repartition(1).sortWithinPartitions(*order).mapInArrow(refill(2), schema)
    done = level0.where("sequence_id IS NOT NULL").union(level1.where("sequence_id IS NOT NULL")).union(level2)
    return done.select(F.col("id").alias(id_col), *(n for n in names[1:] if n != "worker"))

