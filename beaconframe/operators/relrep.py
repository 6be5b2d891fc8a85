"""Relative representations and what is computed with them.

An item's representation is its top-k anchors with processed similarities, in long form
(id, anchor_id, w).  Scores of captions and images are a join on the anchor id with a sum:
the shuffle by anchor is the inverted index, and Spark splits popular anchors (AQE).

Where every pair is wanted, or a count for each caption over all pairs, the pairs aren't
shuffled: representations are packed into sparse blocks, and each task reads all blocks of
images past its blocks of captions.  ``weighted_blocks`` makes such blocks where the
neighbours are found, so that those aren't shuffled either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.functions.ids import running_total
from beaconframe.functions.scratch import materialize
from beaconframe.functions.vectors import EPS, process_weight

from .topk import PLACES, streamed

#: Products of two sparse blocks that are held at once, and bytes of items that wait for their block to fill.
PRODUCTS, WAITING = 500_000, 64_000_000
#: Pairs of blocks, of a few MB each, that a worker gets at once.
BATCH = 4


def weights(topk: DataFrame, *, proc: str = "asif", p: int = 8, clamp_min: float | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """``topk`` with w: clamped after the selection, powered for asif, and divided by the item's norm unless none."""
    v = process_weight(F.col("s"), proc, p, clamp_min)
    if proc == "none":
        return topk.withColumn("w", v)
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*keys)))
    return topk.withColumn("v", v).withColumn("w", F.col("v") / F.greatest(norm, F.lit(EPS))).drop("v")


def scores(captions: DataFrame, images: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, caption_id, image_idx, score) of pairs that share an anchor, rounded to nine places."""
    c = captions.select(*keys, F.col("id").alias("caption_id"), "anchor_id", F.col("w").alias("wc"))
    i = images.select(*keys, F.col("id").alias("image_idx"), "anchor_id", F.col("w").alias("wi"))
    found = c.join(i, [*keys, "anchor_id"]).groupBy(*keys, "caption_id", "image_idx").agg(F.sum(F.col("wc") * F.col("wi")).alias("score"))
    return found.withColumn("score", F.round("score", PLACES))


def _items(representations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(set, id, at, w): a row for each item with its anchors in ascending order."""
    held = representations.groupBy(*keys, "id").agg(F.sort_array(F.collect_list(F.struct("anchor_id", "w"))).alias("e"))
    return held.select(F.concat_ws("\0", *keys).alias("set") if keys else F.lit("").alias("set"), "id", F.col("e.anchor_id").alias("at"), F.col("e.w").alias("w"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists, 0 for null, and all their values."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(lists.value_parent_indices().to_numpy(), minlength=len(lists)), values


_EXTRA = {"gt": "<i8", "g": "<f8"}


def _blocks(items: DataFrame, name: str, rows: int, extra: tuple[str, ...] = (), made=iter) -> DataFrame:
    """Items as blocks of up to ``rows`` of one set: (set, ids, n, at, w, extra...) as bytes under the prefix ``name``; null lists are empty.

    ``made`` makes the items' batches from those of the plan, in the same worker.
    """

    def block(which: str, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        n, at = _flat(part.column("at"))
        short = not len(at) or -(2**31) <= at.min() and at.max() < 2**31
        cols = [part.column("id").to_numpy().astype("<i8"), n.astype("<i8"), at.astype("<i4" if short else "<i8"), _flat(part.column("w"))[1].astype("<f8"), *(part.column(c).to_numpy(zero_copy_only=False).astype(_EXTRA[c]) for c in extra)]
        names = [f"{name}_{c}" for c in ("ids", "n", "at", "w", *extra)]
        return pa.RecordBatch.from_arrays([pa.array([which]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=["set", *names])

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.RecordBatch]] = {}
        size = 0
        for batch in made(parts):
            batch = batch.take(pa.array(np.argsort(batch.column("set").to_numpy(zero_copy_only=False).astype(str), kind="stable")))
            sets = batch.column("set").to_numpy(zero_copy_only=False).astype(str)
            ends = [*np.flatnonzero(sets[1:] != sets[:-1]) + 1, len(sets)] if len(sets) else []
            for begin, end in zip([0, *ends], ends, strict=False):
                which = str(sets[begin])
                while begin < end:
                    mine = held.setdefault(which, [])
                    mine.append(batch.slice(begin, min(end - begin, rows - sum(p.num_rows for p in mine))))
                    begin += mine[-1].num_rows
                    if sum(p.num_rows for p in mine) == rows:
                        yield block(which, held.pop(which))
            size += batch.nbytes
            if size > WAITING:
                yield from (block(which, mine) for which, mine in held.items())
                held, size = {}, 0
        yield from (block(which, mine) for which, mine in held.items())

    return items.mapInArrow(pack, "set string, " + ", ".join(f"{name}_{c} binary" for c in ("ids", "n", "at", "w", *extra)))


def _block(cell: dict, name: str) -> tuple[np.ndarray, ...]:
    """(ids, row, anchor, weight) of the entries of a block."""
    n = np.frombuffer(cell[f"{name}_n"], "<i8")
    w = np.frombuffer(cell[f"{name}_w"], "<f8")
    at = np.frombuffer(cell[f"{name}_at"], "<i4" if len(cell[f"{name}_at"]) == 4 * len(w) else "<i8").astype("<i8")
    return np.frombuffer(cell[f"{name}_ids"], "<i8"), np.repeat(np.arange(len(n)), n), at, w


def weighted_blocks(pairs: DataFrame, lists: Callable, name: str, *, proc: str = "asif", p: int = 8, clamp_min: float | None = None, rows: int = 2048, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of the representations of ``topk.top_k_lists``, made by the workers that find the neighbours; the weights of ``weights``."""
    process_weight(F.lit(0.0), proc, p, clamp_min)

    def weighted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lists(parts):
            (n, at), v = _flat(batch.column("at")), _flat(batch.column("s"))[1]
            row = np.repeat(np.arange(len(n)), n)
            v = v if clamp_min is None else np.maximum(v, clamp_min)
            v = np.power(v, float(p)) if proc == "asif" else v
            w = v if proc == "none" else v / np.maximum(np.sqrt(np.bincount(row, v * v, minlength=len(n))), EPS)[row]
            order = np.lexsort((at, row))
            ends = batch.column("at").offsets
            yield pa.RecordBatch.from_arrays([batch.column("subset_id"), batch.column("id"), *(batch.column(c) for c in extra), *(pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (at, w))], names=["set", "id", *extra, "at", "w"])

    return _blocks(pairs, name, rows, extra, weighted)


def _products(cell: dict, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of a block of captions and one of images that share an anchor, for up to ``most`` captions at a time:
    (first caption, end, caption's row, image's row, rounded score), summed in the order of anchors."""
    c_ids, c_row, c_at, c_w = _block(cell, "c")
    i_ids, i_row, i_at, i_w = _block(cell, "i")
    order = np.argsort(i_at, kind="stable")
    i_row, i_at, i_w = i_row[order], i_at[order], i_w[order]
    begin = np.searchsorted(i_at, c_at, "left")
    n = np.searchsorted(i_at, c_at, "right") - begin
    entries = np.searchsorted(c_row, np.arange(len(c_ids) + 1))
    before = np.concatenate([[0], np.cumsum(n)])[entries]
    first = 0
    while first < len(c_ids):
        end = min(len(c_ids), first + most, max(first + 1, int(np.searchsorted(before, before[first] + PRODUCTS, "right")) - 1))
        e = slice(entries[first], entries[end])
        many = n[e]
        where = np.arange(many.sum()) + np.repeat(begin[e] - (np.cumsum(many) - many), many)
        key = np.repeat(c_row[e], many) * len(i_ids) + i_row[where]
        order = np.argsort(key, kind="stable")
        key, value = key[order], (np.repeat(c_w[e], many) * i_w[where])[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        score = np.bincount(np.cumsum(new) - 1, value) if len(key) else np.empty(0)
        yield first, end, key[new] // len(i_ids), key[new] % len(i_ids), np.round(score, PLACES)
        first = end


def dense_scores(captions: DataFrame, images: DataFrame, all_captions: DataFrame, all_images: DataFrame) -> DataFrame:
    """(caption_id, image_idx, score) of all captions and images, 0 where they share no anchor.

    The same as ``zero_filled`` of ``scores``; rows of the grid are made where they are
    written, and neither they nor the scores are shuffled.
    """

    def items(every: DataFrame, key: str, representations: DataFrame) -> DataFrame:
        return every.select(F.col(key).alias("id")).join(_items(representations, ()).drop("set"), "id", "left").select(F.lit("").alias("set"), "id", "at", "w")

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(batch.num_rows):
                cell = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                c_ids, i_ids = (np.frombuffer(cell[c], "<i8") for c in ("c_ids", "i_ids"))
                for first, end, c, i, score in _products(cell, max(1, 500_000 // len(i_ids))):
                    dense = np.zeros((end - first, len(i_ids)))
                    dense[c - first, i] = score
                    ends = pa.array(np.arange(end - first + 1, dtype="<i4") * len(i_ids))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.tile(i_ids, end - first), dense.ravel())]
                    yield pa.RecordBatch.from_arrays([pa.array(c_ids[first:end]), *lists], names=["caption_id", "ids", "scores"])

    i = materialize(_blocks(items(all_images, "image_idx", images), "i", 8192), "blocks-images")
    c = materialize(_blocks(items(all_captions, "caption_id", captions), "c", 512), "blocks-captions")
    grid = streamed(i, c.repartition(max(1, c.count()))).mapInArrow(fill, "caption_id long, ids array<long>, scores array<double>")
    return grid.select("caption_id", "ids", F.posexplode("scores").alias("_at", "score")).select("caption_id", F.col("ids")[F.col("_at")].alias("image_idx"), "score")


def zero_filled(found: DataFrame, captions: DataFrame, images: DataFrame) -> DataFrame:
    """The dense form: a row for each caption and image, 0 where they share no anchor."""
    grid = captions.select("caption_id").crossJoin(images.select("image_idx"))
    return grid.join(found, ["caption_id", "image_idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ground_truth_rank(found: DataFrame, truth: DataFrame, n_images: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """``truth`` (keys, caption_id, gt, ...) with rank: the place of gt among all images by (score desc, image_idx).

    Only stored scores are read.  The images without one score 0: all of them are ahead of
    a negative gt, those with a smaller index are ahead of a gt of 0, and none of a positive
    one.  ``image_idx`` must be dense from 0.
    """
    s, at, g = F.col("score"), F.col("image_idx"), F.col("gt_score")
    on = [*keys, "caption_id"]
    mine = F.max(F.when(at == F.col("gt"), s)).over(Window.partitionBy(*on))
    stored = found.join(truth.select(*on, "gt"), on).withColumn("gt_score", F.coalesce(mine, F.lit(0.0)))
    counted = stored.groupBy(*on).agg(
        F.first("gt_score").alias("gt_score"), F.count_if((s > g) | ((s == g) & (at < F.col("gt")))).alias("ahead"), F.count(F.lit(1)).alias("stored"), F.count_if(at < F.col("gt")).alias("before")
    )
    return _rank(truth, counted, n_images, on)


def _rank(truth: DataFrame, counted: DataFrame, n_images: Column, on: list[str]) -> DataFrame:
    """``truth`` with rank, from (on, gt_score, ahead, stored, before) of the captions with scores."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    g = F.coalesce(F.col("gt_score"), F.lit(0.0))
    unstored = F.when(g < 0, n_images - n("stored")).when(g == 0, F.col("gt") - n("before")).otherwise(0)
    return truth.join(counted, on, "left").withColumn("rank", (1 + n("ahead") + unstored).cast("long")).drop("ahead", "stored", "before", "gt_score")


def ground_truth_rank_of(captions: DataFrame, images: DataFrame, truth: DataFrame, n_images: Column, key: str) -> DataFrame:
    """As ``ground_truth_rank`` of ``scores``, without a shuffle of scores: from representations (key, id, anchor_id, w).

    ``key`` is a string, and truth has a row for each key and caption.
    """
    wanted = truth.select(F.col(key).alias("set"), F.col("caption_id").alias("id"), F.col("gt").cast("long").alias("gt"))
    c = materialize(_blocks(wanted.join(_items(captions, (key,)), ["set", "id"]), "c", 2048, ("gt",)), "blocks-captions")
    return rank_of_blocks(c.repartition(max(1, c.count())), _blocks(_items(images, (key,)), "i", 8192), truth, n_images, key)


def _own_scores(cell: dict, gt: np.ndarray, g: np.ndarray) -> None:
    """Set ``g``, the scores of captions and their own images, of those whose image is in the cell's block."""
    i_ids, i_row, i_at, i_w = _block(cell, "i")
    _, c_row, c_at, c_w = _block(cell, "c")
    order = np.argsort(i_ids)
    place = order[np.minimum(np.searchsorted(i_ids[order], gt), len(order) - 1)]
    here = i_ids[place] == gt
    e = here[c_row]
    c_row, c_at, c_w = c_row[e], c_at[e], c_w[e]
    code, coded = np.unique(np.concatenate([c_at, i_at]), return_inverse=True)
    mine, theirs = place[c_row] * len(code) + coded[: len(c_at)], i_row * len(code) + coded[len(c_at) :]
    at = np.minimum(np.searchsorted(theirs, mine), max(0, len(theirs) - 1))
    both = theirs[at] == mine if len(theirs) else np.zeros(len(mine), bool)
    g[here] = np.round(np.bincount(c_row[both], c_w[both] * i_w[at[both]], minlength=len(gt)).astype(float), PLACES)[here]


def rank_of_blocks(captions: DataFrame, images: DataFrame, truth: DataFrame, n_images: Column, key: str) -> DataFrame:
    """``ground_truth_rank_of`` from blocks of captions with gt and of images, which are written; those of captions stay in their tasks.

    A task reads all blocks of images past its blocks of captions twice: for the score of each
    caption's own image, and to count the images ahead of that.
    """
    i = materialize(images, "blocks-images", BATCH)
    c_schema = "set string, c_ids binary, c_n binary, c_at binary, c_w binary, c_gt binary, c_g binary"
    c_names = [c.split()[0] for c in c_schema.split(", ")]

    def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[str, bytes], tuple[dict, np.ndarray]] = {}
        for batch in parts:
            for at in range(batch.num_rows):
                cell = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                gt = np.frombuffer(cell["c_gt"], "<i8")
                block, g = blocks.setdefault((cell["set"], cell["c_ids"]), ({c: cell[c] for c in c_names[:-1]}, np.zeros(len(gt))))
                _own_scores(cell, gt, g)
        for block, g in blocks.values():
            yield pa.RecordBatch.from_arrays([pa.array([block["set"]], pa.string()), *(pa.array([x], pa.binary()) for x in (*(block[c] for c in c_names[1:-1]), g.astype("<f8").tobytes()))], names=c_names)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes], np.ndarray] = {}
        scores: dict[tuple[str, bytes], np.ndarray] = {}
        for batch in parts:
            for at in range(batch.num_rows):
                cell = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                block = (cell["set"], cell["c_ids"])
                gt, g, i_ids = np.frombuffer(cell["c_gt"], "<i8"), np.frombuffer(cell["c_g"], "<f8"), np.frombuffer(cell["i_ids"], "<i8")
                counts, scores[block] = found.setdefault(block, np.zeros((3, len(gt)), np.int64)), g
                for first, end, c, i, s in _products(cell, len(gt)):
                    earlier = i_ids[i] < gt[c]
                    for k, which in enumerate((c[(s > g[c]) | ((s == g[c]) & earlier)], c, c[earlier])):
                        counts[k, first:end] += np.bincount(which - first, minlength=end - first)
        for (which, ids), counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([which] * counts.shape[1], pa.string()), pa.array(np.frombuffer(ids, "<i8")), pa.array(scores[which, ids]), *map(pa.array, counts)], names=["_set", "caption_id", "gt_score", "ahead", "stored", "before"])

    counts = streamed(i, streamed(i, captions).mapInArrow(own, c_schema)).mapInArrow(count, "_set string, caption_id long, gt_score double, ahead long, stored long, before long")
    return _rank(truth, materialize(counts, "counts", BATCH).withColumnRenamed("_set", key), n_images, [key, "caption_id"])


def posting_counts(representations: DataFrame) -> DataFrame:
    """(anchor_id, n, start): how many items hold an anchor, and how many postings come before it."""
    n = representations.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"))
    return running_total(n, "start", "n", "anchor_id")
