"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most d bits are cut into d // 2 + 1 segments, so that one
segment differs in at most one bit.  Each segment is indexed under each of its one-wildcard
variants (one bit left out), and fingerprints that agree on a variant meet by equality and
are verified on all bits.

Scale: documents collapse to distinct fingerprints before anything is joined, so a group of
copies costs one row.  Variants are dealt by key and met in a sorted stream that holds one
key's fingerprints at a time and passes on at most one link for each of them (a spanning
forest of the verified pairs), never all pairs.  A key with more than ``max_bucket``
fingerprints is not held at all: its members go on to a second round, under keys that leave
out as many bits of the rest of the fingerprint as the limit still allows.  All members of
such a key are within the limit of each other, so linking each to one of them loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, column, materialize
from .components import components


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit ``hashes`` have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of a text with A-Z lower-cased; 0 without words.

    Words are runs without ASCII white space; a text of fewer than ``width`` words is one
    shingle.  A bit is set if over half the XXH64 values (seed 42) have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    hashed = xxhash.xxh64_intdigest
    return majority(np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[last : last + n].tolist(), strict=True)), np.uint64, n))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            fps = np.array([fingerprint(t, width) for t in column(batch, text_col).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(fps)], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(rows, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _segments(max_bits: int) -> list[list[int]]:
    n = max_bits // 2 + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(max_bits: int) -> list[tuple[int, list[int]]]:
    """For each variant: the bits that its key keeps and the bits outside its segment."""
    out = []
    for segment in _segments(max_bits):
        rest = [b for b in range(64) if b not in segment]
        out += [(sum(1 << b for b in segment if b != gone), rest) for gone in segment]
    return out


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span each group of ``fps`` joined by pairs within ``max_bits``."""
    links, todo = [], np.ones(len(fps), bool)
    for first in range(len(fps)):
        if not todo[first]:
            continue
        todo[first], front = False, [first]
        while front:
            at = front.pop()
            near = np.flatnonzero(todo & (np.bitwise_count(fps ^ fps[at]) <= max_bits))
            todo[near] = False
            front += near.tolist()
            links += [(at, k) for k in near.tolist()]
    return links


def _runs(parts: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(whether it begins a new key, the columns) for each run of equal keys in each sorted batch."""
    before = None
    for batch in parts:
        cols = [column(batch, n).to_numpy(zero_copy_only=False) for n in names]
        if not len(cols[0]):
            continue
        at = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols[:-1]], axis=0)))
        for a, b in zip(at, np.append(at[1:], len(cols[0])), strict=True):
            key = tuple(c[a] for c in cols[:-1])
            yield key != before, [c[a:b] for c in cols]
            before = key


def _link_batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "a", "b"])


def link_fingerprints(fps: DataFrame, *, max_bits: int = 2, max_bucket: int = 2048) -> DataFrame:
    """Links (a, b) between the distinct ``fps`` (fp) that join all that differ in at most ``max_bits`` bits."""
    variants = _keys(max_bits)
    masks = np.array([m for m, _ in variants], np.uint64)

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 4096):
            fp = column(batch, "fp").to_numpy().view(np.uint64)
            for no, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), no, np.int32)), pa.array((fp & mask).view(np.int64)), pa.array(fp.view(np.int64))], names=["no", "part", "fp"])

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        big, no, a, b = False, 0, [], []

        def close() -> None:
            if not big and sum(map(len, held)) > 1:
                own = np.concatenate(held)
                for x, y in _forest(own.view(np.uint64), max_bits):
                    a.append(own[x])
                    b.append(own[y])

        for new, (nos, _, fp) in _runs(parts, ("no", "part", "fp")):
            if new:
                close()
                held, big, no = [], False, int(nos[0])
            held.append(fp)
            if big or sum(map(len, held)) > max_bucket:
                big = True
                own, held = np.concatenate(held), []
                yield _link_batch(no + 1, own, own)
            if len(a) > 10_000:
                yield _link_batch(0, np.array(a), np.array(b))
                a, b = [], []
        close()
        if a:
            yield _link_batch(0, np.array(a), np.array(b))

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of large variants: with bits of the rest left out, for an equal segment and for one that differs."""
        for batch in batches(parts, 16):
            for kind, fp in zip(column(batch, "kind").to_pylist(), column(batch, "a").to_numpy().view(np.uint64), strict=True):
                kept, rest = variants[kind - 1]
                for whole in (True, False):
                    # An equal segment leaves max_bits for the rest, one wildcard bit leaves one less.
                    inside = np.uint64(sum(1 << b for b in range(64) if b not in rest) if whole else kept)
                    gone = np.array([sum(1 << b for b in c) for c in combinations(rest, max_bits - (not whole))], np.uint64)
                    part = fp & (inside | np.uint64(sum(1 << b for b in rest)) & ~gone)
                    n = len(gone)
                    cols = [pa.array(np.full(n, 2 * kind + whole, np.int32)), pa.array(gone.view(np.int64)), pa.array(part.view(np.int64)), pa.array(np.full(n, fp).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["no", "gone", "part", "fp"])

    def star(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for new, (_, _, _, fp) in _runs(parts, ("no", "gone", "part", "fp")):
            hub = fp[0] if new else hub
            fp = fp[fp != hub]
            if len(fp):
                yield _link_batch(0, np.full(len(fp), hub), fp)

    met = (
        fps.select("fp").mapInArrow(spread, "no int, part long, fp long")
        .repartition("no", "part").sortWithinPartitions("no", "part", "fp")
        .mapInArrow(meet, "kind int, a long, b long")
    )
    met = materialize(met, "simhash-links")
    more = (
        met.where("kind > 0").mapInArrow(again, "no int, gone long, part long, fp long")
        .repartition("no", "gone", "part").sortWithinPartitions("no", "gone", "part", "fp")
        .mapInArrow(star, "kind int, a long, b long")
    )
    return met.where("kind = 0").union(more).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, max_bucket: int = 2048) -> DataFrame:
    """(id, fingerprint, component_id) of each row.

    Fingerprints of at most ``max_bits`` differing bits are linked; component_id is the
    smallest id that can be reached over links, the row's own included.  Null and empty
    texts have fingerprint zero and are linked like any other.  Null ids keep their rows and
    are never a component_id unless a component has no other id (then it is null).  Rows
    that repeat an id keep their rows.  An empty table gives no rows; other columns are not
    read.
    """
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    rooted = components(link_fingerprints(distinct, max_bits=max_bits, max_bucket=max_bucket))
    named = distinct.join(rooted, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("own"), "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # Only fingerprints of a component with others need more than their own smallest id.
    named = materialize(named.join(smallest, "root").select("own", "component_id"), "simhash-components")
    return marked.join(named, F.col("fp") == F.col("own")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their component.

    Rows with a null id can't be named and stay; rows that repeat a kept id stay together.
    Other columns pass through, whatever their names.
    """
    found = near_duplicates(docs, id_col=id_col, **options)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone_id")).distinct()
    gone = materialize(gone, "simhash-gone").alias("gone")
    rows = docs.alias("kept")
    return rows.join(gone, F.col(f"kept.{id_col}") == F.col("gone._gone_id"), "left_anti")
