"""Choosing queries, captions and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_queries(captions: DataFrame, *, languages: list[str] | None = None, first_per_image_language: bool = False, max_queries: int | None = None) -> DataFrame:
    """(caption_id, gt, language): filter by language, then the first of each image and language, then a prefix.

    A missing language is the text ``None``, before the filter.
    """
    rows = captions.select("caption_id", F.col("image_idx").alias("gt"), F.coalesce("language", F.lit("None")).alias("language"))
    if languages:
        rows = rows.where(F.col("language").isin(languages))
    if first_per_image_language:
        first = Window.partitionBy("gt", "language").orderBy("caption_id")
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if max_queries is not None:
        rows = rows.orderBy("caption_id").limit(max_queries)
    return rows


def captions_by_image(captions: DataFrame) -> DataFrame:
    """(image_idx, caption_ids): an image's captions in order."""
    return captions.groupBy("image_idx").agg(F.sort_array(F.collect_list("caption_id")).alias("caption_ids"))


def preferred_caption(captions: DataFrame, images: DataFrame, language: str | None) -> DataFrame:
    """(image_idx, caption_id): the first caption in ``language``, else the first of all, else null."""
    other = F.lit(0) if language is None else F.when(F.col("language") == language, 0).otherwise(1)
    picked = captions.groupBy("image_idx").agg(F.min_by("caption_id", F.struct(other, F.col("caption_id"))).alias("caption_id"))
    return images.select("image_idx").join(picked, "image_idx", "left")


def first_caption(captions: DataFrame, images: DataFrame) -> DataFrame:
    """(image_idx, caption_id): the first caption, -1 if there is none."""
    first = captions.groupBy("image_idx").agg(F.min("caption_id").alias("caption_id"))
    return images.select("image_idx").join(first, "image_idx", "left").withColumn("caption_id", F.coalesce("caption_id", F.lit(-1).cast("long")))


def shuffle_key(id_col: str, seed: Column | int) -> Column:
    """A reproducible random order: the digest of id and seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), seed.cast("string")))


def random_subset(anchors: DataFrame, n: int, seed: int, id_col: str = "anchor_id") -> DataFrame:
    """``n`` anchors without replacement, the same for the same seed; ids in ascending order."""
    return anchors.select(id_col).orderBy(shuffle_key(id_col, seed), id_col).limit(n).orderBy(id_col)


def first_n(anchors: DataFrame, n: int, id_col: str = "anchor_id") -> DataFrame:
    """Anchors with an id under ``n``: on files in the order of ids, other row groups aren't read."""
    return anchors.where(F.col(id_col) < n)


def subset_problems(subset: DataFrame, anchors: DataFrame, id_col: str = "anchor_id") -> DataFrame:
    """One row of counts that are all 0 for a valid subset: empty, negative, repeated, unknown."""
    unknown = subset.join(anchors.select(id_col), id_col, "left_anti").select(F.lit(1).alias("unknown"))
    counts = subset.agg(
        (F.count(F.lit(1)) == 0).cast("long").alias("empty"),
        F.count_if(F.col(id_col) < 0).alias("negative"),
        (F.count(F.lit(1)) - F.countDistinct(id_col)).alias("repeated"),
    )
    return counts.crossJoin(unknown.agg(F.count(F.lit(1)).alias("unknown")))


def resume(items: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``items`` whose id isn't done; rows without an id are left out."""
    return items.where(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")).join(done.select(id_col).distinct(), id_col, "left_anti")


def misaligned(left: DataFrame, right: DataFrame, position: str, key: str) -> DataFrame:
    """(position, left_key, right_key) of places where two ordered tables differ or one has no row."""
    a, b = left.select(position, F.col(key).alias("left_key")), right.select(position, F.col(key).alias("right_key"))
    return a.join(b, position, "full").where(~F.col("left_key").eqNullSafe(F.col("right_key")))
