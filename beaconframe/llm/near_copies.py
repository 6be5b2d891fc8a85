"""Near copies by the Jaccard similarity of word shingles: SimHash links first, an exact join for the rest.

Each set of shingles has a SimHash fingerprint.  Fingerprints of few differing bits meet by
equality of their deletion-variant signatures (``simhash.link_fingerprints``); the pairs that
span such a group are verified on whole sets, and what stays linked is a class.

Sets at the limit differ in more bits than such signatures reach, so an exact prefix join looks
for the links between classes.  In any one order of all shingles, two sets of similarity t or
more have a shingle in common among the first n - ceil(t n) + 1 of each.  So only these
prefixes are joined by equality; pairs of one class, and those that sizes and places in the
prefixes rule out, go no further.  Each set has a row of parity bits, in which every shingle
turns one bit over; two sets differ in at least as many shingles as their bits differ, which
rules out most of what is left.  The rest is verified on whole sets.  No pair at or above the
limit is missed, whichever order is taken.  The order puts shingles that are popular in a
sample last, which keeps the groups that meet small.

Scale: equal texts are one node.  Fingerprints list no pairs of a group, only a spanning
forest.  A shingle's group of up to ``max_bucket`` nodes lists its pairs; a larger one first
only links each node to one hub, and lists afterwards the pairs of nodes that aren't yet in one
component and whose parity bits are close, so that neither a large group of near copies nor one
of a common passage lists its pairs.  Groups are streamed in sorted order; nothing is collected but the popular shingles, of which there is a limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import batches, column, materialize
from .components import components


def plain_words(text: str | None) -> bytes:
    """The words of a text with A-Z lower-cased, with a space between; words are runs without ASCII white space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def node_of(words: bytes) -> int:
    return xxhash.xxh3_64_intdigest(words) - (1 << 63)


def shingles(joined: bytes, width: int = 5) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ``plain_words``; fewer than ``width`` words are one shingle."""
    words = joined.split(b" ")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    n, last = max(1, len(words) - width + 1), min(width, len(words)) - 1
    ends = (starts + lengths)[last : last + n]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n))


def _least(t: float, n: np.ndarray | int) -> np.ndarray:
    """The smallest whole number that is at least t * n."""
    return np.ceil(t * np.asarray(n, np.float64) - 1e-9).astype(np.int64)


def _popular(docs: DataFrame, text_col: str, width: int, one_in: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles in at least ``least`` texts of a sample; they only shape the order."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            found = [shingles(plain_words(t), width) for t in column(batch, text_col).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    sample = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(one_in)) == 0)
    counts = sample.mapInArrow(rows, "shingle long").groupBy("shingle").count().where(F.col("count") >= least)
    found = counts.orderBy(F.desc("count"), "shingle").limit(most).toArrow()
    hashes = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["count"].to_numpy()[order]


def _prefix(own: np.ndarray, popular: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    hashes, counts = popular
    weight = np.zeros(len(own), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        weight = np.where(hashes[at] == own, counts[at], 0)
    return own[np.lexsort((own, weight))[: len(own) - int(_least(similarity, len(own))) + 1]]


def _possible(sizes: np.ndarray, places: np.ndarray, at: int, rest: slice, similarity: float) -> np.ndarray:
    """Which of ``rest`` can be at the limit with the row at ``at``, if what they meet in is the first they share."""
    a, b = sizes[at], sizes[rest]
    shared = np.minimum(a - places[at], b - places[rest])
    return (np.minimum(a, b) >= _least(similarity, np.maximum(a, b))) & (shared >= _least(similarity / (1 + similarity), a + b))


def _parity(own: np.ndarray) -> bytes:
    """A bit for each class of hashes: whether the set has an odd number of them.  There are as many classes as shingles, or up to twice as many, and 512 at least."""
    classes = max(512, 1 << (len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).astype(np.uint8)).tobytes()


def _folded(rows: np.ndarray, length: int) -> np.ndarray:
    """The same rows of parity bits (the last axis) with ``length`` bytes for fewer classes."""
    while rows.shape[-1] > length:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def _differ(x: bytes, y: bytes) -> int:
    """In how many bits two rows of parity bits differ, the longer one folded to the classes of the other."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ _folded(y, len(x))).sum())


def _near_parity(parity: list[bytes], sizes: np.ndarray, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function that gives those of some places whose parity bits allow a copy of the row at a place."""
    lengths = np.array([len(p) for p in parity])
    by_length = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()}
    bits = {n: np.frombuffer(b"".join(parity[i] for i in at.tolist()), np.uint8).reshape(-1, n) for n, at in by_length.items()}

    def near(at: int, others: np.ndarray) -> np.ndarray:
        mine, found = np.frombuffer(parity[at], np.uint8), []
        for n, places in by_length.items():
            some = others[lengths[others] == n]
            both = min(n, len(mine))
            apart = np.bitwise_count(_folded(bits[n][np.searchsorted(places, some)], both) ^ _folded(mine, both)).sum(axis=1, dtype=np.int64)
            found.append(some[apart <= (sizes[at] + sizes[some]) * (1 - similarity) / (1 + similarity) + 1e-9])
        return np.concatenate(found)

    return near


def _by_parity(pairs: DataFrame, nodes: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of different ``classes`` (of, root) whose parity bits differ in no more places than sets that are alike may differ in shingles."""

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 1024):
            most = (column(batch, "size_x").to_numpy() + column(batch, "size_y").to_numpy()) * (1 - similarity) / (1 + similarity) + 1e-9
            keep = [_differ(x, y) <= m for x, y, m in zip(column(batch, "parity_x").to_pylist(), column(batch, "parity_y").to_pylist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    placed = nodes.join(classes, F.col("node") == F.col("of"), "left").select("node", "size", "parity", F.coalesce("root", "node").alias("root"))
    of = lambda n: placed.toDF(*(f"{c}_{n}" for c in placed.columns))
    both = pairs.join(of("x"), F.col("a") == F.col("node_x")).join(of("y"), F.col("b") == F.col("node_y")).where("root_x <> root_y")
    return both.select("a", "b", "size_x", "size_y", "parity_x", "parity_y").mapInArrow(near, "a long, b long")


def _can_be_copies(similarity: float) -> Column:
    """The same of the columns size_x, size_y, place_x and place_y."""
    least = lambda t, n: F.ceil(F.lit(t) * n - 1e-9)
    sizes = F.least("size_x", "size_y") >= least(similarity, F.greatest("size_x", "size_y"))
    shared = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    return sizes & (shared >= least(similarity / (1 + similarity), F.col("size_x") + F.col("size_y")))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _sieve(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], most_bits: int) -> Broadcast[np.ndarray]:
    """A bit row in which the last bits of each of ``values`` are set: at least 128 bits for each row, ``most_bits`` (a power of two) at most.

    It keeps most rows that aren't wanted out of a shuffle, whatever the size of the table;
    those that it lets through are for an exact join.
    """
    bits = min(most_bits, max(1 << 12, 1 << (128 * rows.count()).bit_length()))

    def words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 1 << 14):
            slots = values(batch) & np.uint64(bits - 1)
            at, back = np.unique(slots >> np.uint64(6), return_inverse=True)
            own = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(own, back, np.uint64(1) << (slots & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(own.view(np.int64))], names=["at", "own"])

    found = rows.mapInArrow(words, "at long, own long").groupBy("at").agg(F.bit_or("own").alias("own")).toArrow()
    sieve = np.zeros(bits >> 6, np.uint64)
    sieve[found["at"].to_numpy()] = found["own"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(sieve)


def _passes(sieve: np.ndarray, values: np.ndarray) -> np.ndarray:
    slots = values & np.uint64((len(sieve) << 6) - 1)
    return (sieve[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def _verified(docs: DataFrame, pairs: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are at least ``similarity`` alike."""

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            words = [plain_words(t) for t in column(batch, text_col).to_pylist()]
            nodes = np.array([node_of(w) for w in words], np.int64)
            keep = pa.array(_passes(sent.value, nodes.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes).filter(keep), pa.array(words, pa.binary()).filter(keep)], names=["node", "words"])

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            own = [shingles(w, width).tobytes() for w in column(batch, "words").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(own, pa.binary())], names=["node", "own"])

    def alike(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 1024):
            keep = []
            for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("needed")).distinct(), "copies-needed")
    sent = _sieve(needed, lambda batch: column(batch, "needed").to_numpy().view(np.uint64), 1 << 28)
    asked = docs.select(text_col).mapInArrow(texts, "node long, words binary").join(needed, F.col("node") == F.col("needed"), "left_semi")
    own = asked.mapInArrow(sets, "node long, own binary").groupBy("node").agg(F.first("own").alias("own"))
    own = materialize(own, "copies-sets")
    x, y = own.select(F.col("node").alias("node_x"), F.col("own").alias("x")), own.select(F.col("node").alias("node_y"), F.col("own").alias("y"))
    both = pairs.join(x, F.col("a") == F.col("node_x")).join(y, F.col("b") == F.col("node_y")).select("a", "b", "x", "y")
    return materialize(both.mapInArrow(alike, "a long, b long"), "copies-links")


def near_fingerprints(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) that span each group of ``nodes`` (node, fp) joined by fingerprints of at most ``max_bits`` differing bits.

    One node stands for all of its fingerprint; the others of it are paired with that one.
    """
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts, "copies-fingerprints")
    x, y = (firsts.select(F.col("fp").alias(f"fp_{of}"), F.col("first").alias(f"first_{of}")) for of in "xy")
    near = simhash.link_fingerprints(firsts, max_bits=max_bits).join(x, F.col("a") == F.col("fp_x")).join(y, F.col("b") == F.col("fp_y"))
    same = nodes.select("node", "fp").join(firsts.where("n > 1"), "fp").where("node <> first")
    pairs = near.select("first_x", "first_y").union(same.select("first", "node")).toDF("x", "y")
    return materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "copies-near")


def link_copies(docs: DataFrame, nodes: DataFrame, *, text_col: str, width: int, similarity: float, max_bucket: int, max_bits: int) -> DataFrame:
    """Links (a, b) that join all of ``nodes`` (node, size, fp, parity, prefix) with at least ``similarity``."""

    def groups(parts: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(shingle, the columns) of each run of a shingle in each sorted batch, without runs of one row that no other batch can go on with."""
        for batch in parts:
            if not batch.num_rows:
                continue
            keys, cols = column(batch, "shingle").to_numpy(), [column(batch, n).to_numpy(zero_copy_only=False) for n in names]
            starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            ends = np.append(starts[1:], len(keys))
            some = ends - starts > 1
            some[[0, -1]] = True
            for x, y in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                yield keys[x], [c[x:y] for c in cols]

    def hubs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each large group the first row with all others that it can be a copy of."""
        key, hub = None, None
        for new, (node, size, place) in groups(parts, ("node", "size", "place")):
            if new != key:
                key, hub = new, (node[0], size[0], place[0])
            near = _possible(np.append(hub[1], size), np.append(hub[2], place), 0, slice(1, None), similarity) & (node != hub[0])
            if near.any():
                yield _pairs([np.full(near.sum(), hub[0])], [node[near]])

    def across(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of a large group that aren't in one component and whose parity bits don't rule them out."""
        key, held, a, b, n = None, [], [], [], 0

        def listed() -> Iterator[pa.RecordBatch]:
            nonlocal a, b, n
            node, size, place, root, parity = (np.concatenate(c) for c in zip(*held, strict=True))
            if (root == root[0]).all():
                return
            by_parity = _near_parity(parity.tolist(), size, similarity)
            for i in range(len(node) - 1):
                near = i + 1 + np.flatnonzero(_possible(size, place, i, slice(i + 1, None), similarity) & (root[i + 1 :] != root[i]))
                near = by_parity(i, near) if len(near) else near
                if len(near):
                    a.append(np.full(len(near), node[i]))
                    b.append(node[near])
                    n += len(near)
                if n > 10_000:
                    yield _pairs(a, b)
                    a, b, n = [], [], 0

        for new, cols in groups(parts, ("node", "size", "place", "root", "parity")):
            if new != key and held:
                yield from listed()
                held = []
            key = new
            held.append(cols)
        if held:
            yield from listed()
        if a:
            yield _pairs(a, b)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("shingle").sortWithinPartitions("shingle", "node")

    alike = _verified(docs, near_fingerprints(nodes, max_bits), text_col, width, similarity)
    classes = materialize(components(alike).withColumnRenamed("node", "of"), "copies-classes")
    # Most shingles of prefixes are in one node only; they don't leave the JVM.
    spread = nodes.select("node", "size", F.posexplode("prefix").alias("place", "shingle"))
    shared = spread.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("n > 1")
    shared = materialize(shared, "copies-shared")
    small, large = (shared.where(c).select("shingle", "node", "size", "place") for c in (F.col("n") <= max_bucket, F.col("n") > max_bucket))
    x, y = (small.select("shingle", *(F.col(c).alias(f"{c}_{of}") for c in ("node", "size", "place"))) for of in "xy")
    met = x.join(y, "shingle").where("node_x < node_y").where(_can_be_copies(similarity)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    met = met.union(dealt(large).mapInArrow(hubs, "a long, b long"))
    met = materialize(_by_parity(met.distinct(), nodes, classes, similarity), "copies-met")
    links = alike.union(_verified(docs, met, text_col, width, similarity))
    if not large.limit(1).count():
        return links
    classes = materialize(components(links).withColumnRenamed("node", "of"), "copies-classes")
    large = large.join(classes, F.col("node") == F.col("of"), "left").select("shingle", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    large = large.join(nodes.select(F.col("node").alias("own"), "parity"), F.col("node") == F.col("own")).drop("own")
    more = materialize(dealt(large).mapInArrow(across, "a long, b long").distinct(), "copies-more")
    return links.union(_verified(docs, more, text_col, width, similarity))


def _raw_sum(text: str | None) -> bytes:
    """Tells texts apart as they are, null from empty."""
    return b"" if text is None else xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _one_of_each(marked: DataFrame) -> DataFrame:
    """The row of the smallest row_no of each node.

    Only node and row_no are shuffled to find the others, and those are left out by row_no, of
    which there are no large groups; prefixes stay where they are while the others' numbers
    are small enough for Spark to broadcast.
    """
    places = marked.select("node", "row_no")
    firsts = places.groupBy(F.col("node").alias("of")).agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spare = places.join(firsts, F.col("node") == F.col("of")).where(F.col("row_no") != F.col("first"))
    spare = materialize(spare.select(F.col("row_no").alias("spare_no")), "copies-spare")
    return marked.join(spare, F.col("row_no") == F.col("spare_no"), "left_anti")


def _marked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_bits: int = 3, max_bucket: int = 64, one_in: int = 32, popular: int = 4, most_popular: int = 1 << 20) -> DataFrame:
    """(id, sum, n, root, best) for each id and text, ``n`` rows: the component, and the (missing, id, sum) of the row to keep of it."""
    order = _popular(docs, text_col, width, one_in, popular, most_popular)
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            texts = column(batch, text_col).to_pylist()
            words = [plain_words(t) for t in texts]
            own = [shingles(w, width) for w in words]
            prefixes = [_prefix(s, sent.value, similarity).view(np.int64) for s in own]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            parity = pa.array(map(_parity, own), pa.binary())
            fps = pa.array(np.array([simhash.majority(s) for s in own], np.uint64).view(np.int64))
            cols = [column(batch, id_col), pa.array([_raw_sum(t) for t in texts], pa.binary()), pa.array([node_of(w) for w in words], pa.int64()), pa.array([len(s) for s in own], pa.int32()), fps, parity, lists]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "sum", "node", "size", "fp", "parity", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(id_col, text_col).mapInArrow(mark, f"id {kind}, sum binary, node long, size int, fp long, parity binary, prefix array<long>")
    marked = materialize(marked.withColumn("row_no", F.monotonically_increasing_id()), "copies-marked")
    nodes = _one_of_each(marked).select("node", "size", "fp", "parity", "prefix")
    links = link_copies(docs, nodes, text_col=text_col, width=width, similarity=similarity, max_bucket=max_bucket, max_bits=max_bits)
    rooted = components(links).withColumnRenamed("node", "of")
    rows = marked.groupBy("id", "sum", "node").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(rooted, F.col("node") == F.col("of"), "left").select("id", "sum", "n", F.coalesce("root", "node").alias("root"))
    rows = materialize(rows, "copies-rows")
    best = rows.groupBy(F.col("root").alias("whole")).agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "sum")).alias("best"))
    return materialize(rows.join(best, F.col("root") == F.col("whole")).select("id", "sum", "n", "root", "best"), "copies-components")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, component_id) of each row.

    Rows whose sets of ``width``-word shingles have a Jaccard similarity of at least
    ``similarity`` are linked; component_id is the smallest id that can be reached over
    links, the row's own included.  Null and empty texts are linked with each other.  Null
    ids are never a component_id unless a component has no other id (then it is null).

    ``one_in``, ``popular`` and ``most_popular`` shape the order of the shingles, and with
    ``max_bits`` and ``max_bucket`` the work, not the result.
    """
    rows = _marked(docs, id_col=id_col, **options)
    return rows.select(F.col("id").alias(id_col), F.col("best.id").alias("component_id"), F.explode(F.expr("sequence(1, n)"))).drop("col")


def _heads(sums: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(s[:8], "little") for s in sums.to_pylist()], np.uint64)


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sieve_bits: int = 1 << 28, **options) -> DataFrame:
    """One row of ``docs`` for each component: of the smallest id, null ids last, then of the smallest digest of the text.

    Of rows equal in both, the first as JSON stays.  Other columns pass through, whatever
    their names.

    Whole rows are shuffled only if a bit row of the digests to leave out (up to
    ``sieve_bits``, sent to all workers) says that they may be among these; the join that
    decides is exact, so that a full bit row costs shuffle and no row.
    """
    found = _marked(docs, id_col=id_col, text_col=text_col, **options)
    kept = F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.sum") == F.col("sum"))
    marks = found.where(~kept | (F.col("n") > 1)).select(F.col("id").alias("marked_id"), F.col("sum").alias("marked_sum"), kept.alias("again"))
    marks = materialize(marks, "copies-marks")
    sent = _sieve(marks.select("marked_sum"), lambda batch: _heads(column(batch, "marked_sum")), sieve_bits)

    def tagged(parts: Iterator[pa.RecordBatch], doubtful: bool) -> Iterator[pa.RecordBatch]:
        """The rows that the bit row has (``doubtful``) or hasn't."""
        for batch in batches(parts):
            sums = pa.array([_raw_sum(t) for t in column(batch, text_col).to_pylist()], pa.binary())
            keep = pa.array(_passes(sent.value, _heads(sums)) == doubtful)
            cols = [batch.to_struct_array(), column(batch, id_col), sums]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["row", "id", "sum"])

    shape = T.StructType([T.StructField("row", docs.schema), T.StructField("id", docs.schema[id_col].dataType), T.StructField("sum", T.BinaryType())])
    clear, rows = (docs.mapInArrow(partial(tagged, doubtful=d), shape) for d in (False, True))
    same = F.col("id").eqNullSafe(F.col("marked_id")) & (F.col("sum") == F.col("marked_sum"))
    out = clear.select("row").union(rows.join(marks, same, "left_anti").select("row"))
    again = marks.where("again")
    if again.limit(1).count():
        repeated = rows.join(again, same, "left_semi").groupBy("id", "sum").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.union(repeated.select("row"))
    return out.select("row.*")
