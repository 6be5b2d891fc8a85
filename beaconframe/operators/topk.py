"""Exact top-k by cosine similarity, as a plan and as a block kernel.

Both give (id, anchor_id, s, rk) in the total order (similarity descending, anchor id
ascending), with similarities rounded to nine places before they are ranked.

``top_k_plan`` is the declarative form: a nested-loop join with a per-query rank.  The k-th
best similarity among a part of the anchors is one that the k-th best of all isn't below, so
passes over more and more anchors give a bound, and the last, which reads all, rounds and
sorts only pairs that reach it.  ``top_k_blocks`` packs both sides into matrix
blocks and multiplies each pair of blocks in one call; a block row is a few MB, so neither
side has to fit anywhere.  A task reads all blocks of anchors past its blocks of queries and
keeps the best of each query, so that only those go on to the final rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.functions.scratch import materialize
from beaconframe.functions.vectors import dot

PLACES = 9
#: Queries that are multiplied with a block of anchors at once.
SLICE = 128
#: Of the plan: components that are written out, for Spark compiles a join of up to 100 columns (longer vectors are
#: multiplied as arrays, which is slow); bytes of anchors that are sent to all workers; pairs for a task; anchors of a pass for one of the pass before.
WRITTEN, SENT, PAIRS, STEP = 48, 64_000_000, 20_000_000, 8


def ranked(scores: DataFrame, k: int, group: str = "id", item: str = "anchor_id", score: str = "s", rank: str = "rk") -> DataFrame:
    """The best ``k`` of each group; Spark keeps k rows of each group in each task before it shuffles."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def _levels(n: int, k: int) -> list[int]:
    """One in how many of ``n`` anchors each pass reads; the last reads all."""
    levels = [1]
    while n // (levels[0] * STEP) >= 4 * k:
        levels.insert(0, levels[0] * STEP)
    return levels


def top_k_plan(queries: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``queries`` (id, vec) against ``anchors`` (anchor_id, vec); vectors are unit and of one length."""
    q, a = (materialize(rows.select(F.col(key), F.col("vec").cast("array<double>").alias("vec")), f"plan-{key}") for rows, key in ((queries, "id"), (anchors, "anchor_id")))
    (n_q, *sizes_q), (n_a, *sizes_a) = (rows.agg(F.count(F.lit(1)), F.min(F.when(F.col("vec").isNotNull(), F.size("vec"))), F.max(F.size("vec"))).first() for rows in (q, a))
    d = sizes_q[1] if len({*sizes_q, *sizes_a}) == 1 else None
    if written := d is not None and 0 < d <= WRITTEN:
        # Only the first component is null, where any is, so that code for a pair asks once.
        whole = F.when(~F.exists("vec", F.isnull), F.get("vec", F.lit(0)))
        q, a = (rows.select(key, *((whole if i == 0 else F.coalesce(F.get("vec", F.lit(i)), F.lit(0.0))).alias(f"{name}{i}") for i in range(d))) for rows, key, name in ((q, "id", "q"), (a, "anchor_id", "a")))
        product = reduce(add, (F.col(f"q{i}") * F.col(f"a{i}") for i in range(d)))
    else:
        q, a = q.withColumnRenamed("vec", "q"), a.withColumnRenamed("vec", "a")
        product = dot("q", "a")
    tasks = max(2 * q.sparkSession.sparkContext.defaultParallelism, n_q * n_a // PAIRS)
    bound = None
    for level in _levels(n_a, k):
        some = a.where(F.pmod(F.xxhash64("anchor_id"), F.lit(level)) == 0) if level > 1 else a
        some = some.hint("broadcast" if n_a // level * 8 * ((d or 0) + 2) <= SENT and written else "shuffle_replicate_nl")
        if bound is None:
            pairs = q.repartition(tasks, "id").crossJoin(some)
        else:
            # What is below this by less than a rounding step may still be among the best.
            least = F.coalesce(F.col("_bound") - 10.0**-PLACES, F.lit(-math.inf))
            pairs = q.join(bound, "id", "left").select(*q.columns, least.alias("_least")).repartition(tasks, "id").join(some, F.coalesce(product, F.lit(-math.inf)) >= F.col("_least"))
        found = ranked(pairs.select("id", "anchor_id", F.round(product, PLACES).alias("s")), k)
        if level > 1:
            bound = materialize(found.where(F.col("rk") == k).select("id", F.col("s").alias("_bound")), "plan-bound")
    return found


def _packed(rows: DataFrame, key: str, block_rows: int, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(name_ids, name_m, name_d, extra...): blocks of up to ``block_rows`` rows as bytes of one matrix; ``extra`` are whole numbers."""
    more = [f"{name}_{c}" for c in extra]

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _rechunked(parts, block_rows):
            ids = part.column(0).to_numpy().astype("<i8")
            m = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            rest = [pa.array([part.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in extra]
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([len(m) // len(ids)], pa.int32()), *rest], names=[f"{name}_ids", f"{name}_m", f"{name}_d", *more])

    packed = rows.select(F.col(key).cast("long"), F.col("vec").cast("array<double>"), *(F.col(c).cast("long") for c in extra)).where(F.size("vec") > 0)
    # Stored, because a product of two plans makes one side again for each partition of the other.
    return materialize(packed.mapInArrow(pack, ", ".join([f"{name}_ids binary, {name}_m binary, {name}_d int", *(f"{c} binary" for c in more)])), f"blocks-{name}")


def _rechunked(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last one of a partition smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in parts:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, size - n))
            at, n = at + held[-1].num_rows, n + held[-1].num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def streamed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of block rows, where each task holds its own part of ``right`` and reads all of ``left`` past it.

    So a task sees all that a block of ``right`` is paired with, and can give results for the
    block instead of for each pair.  Pairs of blocks with different ``set`` are left out where both have one.
    """
    left = left.coalesce(1).hint("shuffle_replicate_nl")
    return left.join(right.withColumnRenamed("set", "_set"), F.col("set") == F.col("_set")).drop("_set") if "set" in left.columns else left.crossJoin(right)


def _of_item(row: np.ndarray, s: np.ndarray, item: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` of each of ``n`` rows as (row, s, item), in the order of rows and ranks, and what a further one must reach."""
    order = np.lexsort((item, -s, row))
    row, s, item = row[order], s[order], item[order]
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    keep = np.arange(len(row)) - begin[row] < k
    least = np.full(n, -np.inf)
    full = count >= k
    least[full] = s[begin[full] + k - 1]
    return row[keep], s[keep], item[keep], least


def _lists(name: str, ids: np.ndarray, extra: dict[str, np.ndarray], found: tuple[np.ndarray, ...], k: int, leave_own: bool) -> pa.RecordBatch:
    """A row for each query with neighbours, which it has in the order of ranks; without its own anchor, if that is left out."""
    row, s, item = found
    if leave_own:
        other = item != ids[row]
        row, s, item = row[other], s[other], item[other]
    count = np.bincount(row, minlength=len(ids))
    keep = np.arange(len(row)) - (np.cumsum(count) - count)[row] < k
    s, item, count = s[keep], item[keep], np.minimum(count, k)
    some = count > 0
    ends = pa.array(np.concatenate([[0], np.cumsum(count[some])]).astype("<i4"))
    columns = {"subset_id": pa.array([name] * int(some.sum()), pa.string()), "id": pa.array(ids[some])} | {c: pa.array(x[some]) for c, x in extra.items()}
    return pa.RecordBatch.from_pydict(columns | {"at": pa.ListArray.from_arrays(ends, pa.array(item)), "s": pa.ListArray.from_arrays(ends, pa.array(s))})


def _multiply(k: int, subsets: bool, leave_own: bool = False, extra: tuple[str, ...] = ()):
    """The function that multiplies pairs of blocks and gives the best ``k`` of each query at the end; for subsets ``_lists`` of each."""
    most = k + leave_own
    below = 10.0**-PLACES  # A product that is less by this can't be as large after rounding.

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[bytes, int], dict] = {}
        more: dict[bytes, dict[str, np.ndarray]] = {}
        for batch in parts:
            for at in range(batch.num_rows):
                cell = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                a_ids, d = np.frombuffer(cell["a_ids"], "<i8"), cell["a_d"]
                if cell["q_d"] != d:
                    raise ValueError(f"vectors of {cell['q_d']} and {d} components")
                anchors_t, q_m = np.frombuffer(cell["a_m"], "<f8").reshape(-1, d).T, np.frombuffer(cell["q_m"], "<f8").reshape(-1, d)
                names = cell["a_sets"] if subsets else [None]
                more[cell["q_ids"]] = {c: np.frombuffer(cell[f"q_{c}"], "<i8") for c in extra}
                inside = np.unpackbits(np.frombuffer(cell["a_bits"], np.uint8).reshape(len(names), -1), axis=1, count=len(a_ids)).astype(bool) if subsets else [np.ones(len(a_ids), bool)]
                for first in range(0, len(q_m), SLICE):
                    s = q_m[first : first + SLICE] @ anchors_t
                    held = best.setdefault((cell["q_ids"], first), {})
                    empty = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.full(len(s), -np.inf))
                    least = []
                    for name, mine in zip(names, inside, strict=True):
                        known = held.setdefault(name, empty)[3]
                        if np.isinf(known).any() and (n := np.count_nonzero(mine)) > most:
                            known = np.maximum(known, np.partition(s if n == len(mine) else s[:, mine], -most, axis=1)[:, -most])
                        least.append(known)
                    # One pass over the products for all subsets: what none of them can use goes first.
                    i, j = np.nonzero(s >= np.minimum.reduce(least)[:, None] - below)
                    x = s[i, j]
                    for name, mine, known in zip(names, inside, least, strict=True):
                        use = mine[j] & (x >= known[i] - below)
                        row, old, item, _ = held[name]
                        held[name] = _of_item(np.concatenate([row, i[use]]), np.concatenate([old, np.round(x[use], PLACES)]), np.concatenate([item, a_ids[j[use]]]), len(s), most)
        for (q_ids, first), held in best.items():
            ids = np.frombuffer(q_ids, "<i8")[first : first + SLICE]
            for name, (row, s, item, _) in held.items():
                if subsets:
                    yield _lists(name, ids, {c: x[first : first + SLICE] for c, x in more[q_ids].items()}, (row, s, item), k, leave_own)
                else:
                    yield pa.RecordBatch.from_pydict({"id": pa.array(ids[row]), "anchor_id": pa.array(item), "s": pa.array(s)})

    return multiply


def _spread(queries: DataFrame, query_rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """The blocks of the queries, one to a task."""
    blocks = _packed(queries, "id", query_rows, "q", extra)
    return blocks.repartition(max(1, blocks.count()))


def top_k_blocks(queries: DataFrame, anchors: DataFrame, k: int, *, query_rows: int = 2048, anchor_rows: int = 8192) -> DataFrame:
    """As ``top_k_plan``; pairs of blocks whose vectors differ in length raise an error."""
    pairs = streamed(_packed(anchors, "anchor_id", anchor_rows, "a"), _spread(queries, query_rows))
    return ranked(pairs.mapInArrow(_multiply(k, False), "id long, anchor_id long, s double"), k)


def top_k_lists(queries: DataFrame, anchors: DataFrame, k: int, *, leave_own: bool = False, extra: tuple[str, ...] = (), query_rows: int = 2048, anchor_rows: int = 8192) -> tuple[DataFrame, Callable]:
    """For ``anchors`` (anchor_id, vec, subsets): pairs of blocks, and the function that makes (subset_id, id, extra..., at, s) of them.

    A row has the best k of a query within a subset, in the order of ranks; with ``leave_own``
    those but the query's own anchor.  A task sees all anchors, so its lists are whole and
    nothing is ranked after it; the function is for ``mapInArrow``, alone or before another
    in the same worker.  All subsets share the products of a pair of blocks; only their best
    rows differ.  A block of anchors has its subsets' names and a matrix of bits that says
    which anchor is in which.
    """

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _rechunked(parts, anchor_rows):
            m = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            sets, owners = part.column(2).flatten(), part.column(2).value_parent_indices().to_numpy()
            coded = sets.dictionary_encode()
            inside = np.zeros((len(coded.dictionary), part.num_rows), bool)
            inside[coded.indices.to_numpy(), owners] = True
            cols = [pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([len(m) // part.num_rows], pa.int32()), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([np.packbits(inside, axis=1).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["a_ids", "a_m", "a_d", "a_sets", "a_bits"])

    rows = anchors.select(F.col("anchor_id").cast("long"), F.col("vec").cast("array<double>"), F.col("subsets").cast("array<string>")).where(F.size("vec") > 0)
    blocks = materialize(rows.mapInArrow(pack, "a_ids binary, a_m binary, a_d int, a_sets array<string>, a_bits binary"), "blocks-subsets")
    # Few queries are dealt in smaller blocks, so that all workers have some.
    query_rows = min(query_rows, max(SLICE, -(-queries.count() // (3 * queries.sparkSession.sparkContext.defaultParallelism))))
    return streamed(blocks, _spread(queries, query_rows, extra)), _multiply(k, True, leave_own, extra)


def top_k_subsets(queries: DataFrame, anchors: DataFrame, k: int, *, query_rows: int = 2048, anchor_rows: int = 8192) -> DataFrame:
    """(subset_id, id, anchor_id, s, rk) for ``anchors`` (anchor_id, vec, subsets): the best k within each subset."""
    pairs, lists = top_k_lists(queries, anchors, k, query_rows=query_rows, anchor_rows=anchor_rows)
    found = pairs.mapInArrow(lists, "subset_id string, id long, at array<long>, s array<double>").select("subset_id", "id", F.posexplode(F.arrays_zip("at", "s")).alias("_at", "_e"))
    return found.select("subset_id", "id", F.col("_e.at").alias("anchor_id"), F.col("_e.s").alias("s"), (F.col("_at") + 1).alias("rk"))


def without_self(found: DataFrame, k: int, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The best ``k`` that aren't the item's own anchor, from the best k + 1."""
    order = Window.partitionBy(*keys).orderBy("rk")
    return found.where("anchor_id != id").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def top_k(queries: DataFrame, anchors: DataFrame, k: int, *, method: str = "blocks") -> DataFrame:
    if k < 1:
        raise ValueError("k is at least 1")
    if method not in ("blocks", "plan"):
        raise ValueError(f"unknown method {method!r}")
    return top_k_blocks(queries, anchors, k) if method == "blocks" else top_k_plan(queries, anchors, k)


def single_query_top_k(scores: DataFrame, k: int, item: str = "anchor_id", score: str = "s") -> DataFrame:
    """The best ``k`` of one query's scores with a rank from 1."""
    best = scores.orderBy(F.desc(score), F.asc(item)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(item))))
