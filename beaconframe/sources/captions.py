"""Caption records with languages as keys, and the index tables made from them.

A record is one JSON object a line.  Its keys are data, not schema, and their order counts
(captions are numbered by it), so lines are read as text and parsed into maps, which keep
the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.functions.ids import dense_ids

_IDS = ("image/key", "image_id", "id", "image")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines that aren't blank, numbered from 0 in the order of the files' paths and of their lines.

    Spark reads the larger splits first, so lines are ordered by file, by the place of the
    split in it and by the place in the split.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return dense_ids(placed, "line_no", "file", "block", "place").select("line_no", "value")


def _strings(value: Column) -> Column:
    """A JSON string or list as a list of its strings; elements of other kinds are left out, and other kinds have none."""
    listed = F.transform(F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.array(value.cast("string"))).when(kind.startswith("ARRAY"), listed).otherwise(F.array().cast("array<string>"))


def parse_records(lines: DataFrame, *, id_keys: tuple[str, ...] = _IDS, field: str | None = None, drop_blank: bool = False) -> DataFrame:
    """(line_no, image_id, entries): entries lists (language, captions) in the order of the record.

    Keys that begin with ``image/`` and the id keys are no languages, nor are keys whose
    value is no object.  ``field`` names the list to take (``caption`` or ``captions`` if it
    is None); a caption may be a string or a list, elements that aren't strings are left
    out, and with ``drop_blank`` blank ones too.  Languages without captions vanish, and
    records without an id or without any caption.
    """
    # Values stay variants: what looks like a list or an object inside a string is a string.
    record = lines.select("line_no", F.from_json("value", "map<string,variant>").alias("m"))
    ids = F.coalesce(*(F.nullif(F.try_variant_get(F.col("m")[k], "$", "string"), F.lit("")) for k in id_keys))
    of = F.map_filter("m", lambda k, v: ~F.startswith(k, F.lit("image/")) & ~k.isin(list(id_keys)) & F.schema_of_variant(v).startswith("OBJECT"))
    languages = F.transform(F.map_entries(of), lambda e: F.struct(e["key"].alias("language"), F.try_variant_get(e["value"], "$", "map<string,variant>").alias("body")))
    pick = (lambda b: b[field]) if field else (lambda b: F.coalesce(F.when(F.to_json(b["caption"]).isin('""', "[]", "null"), F.lit(None)).otherwise(b["caption"]), b["captions"]))
    good = (lambda s: F.filter(s, lambda x: x.isNotNull() & (F.trim(x) != ""))) if drop_blank else (lambda s: F.filter(s, lambda x: x.isNotNull()))
    entries = F.transform("languages", lambda e: F.struct(e["language"].alias("language"), good(_strings(pick(e["body"]))).alias("captions")))
    return (
        record.select("line_no", ids.alias("image_id"), languages.alias("languages")).where(F.col("image_id").isNotNull())
        .select("line_no", "image_id", F.filter(entries, lambda e: F.size(e["captions"]) > 0).alias("entries"))
        .where(F.size("entries") > 0)
    )


def with_images(records: DataFrame, files: DataFrame) -> DataFrame:
    """Only the records whose image is among ``files`` (image_id)."""
    return records.join(files.select("image_id").distinct(), "image_id", "left_semi")


def build_images(records: DataFrame, max_images: int | None = None) -> DataFrame:
    """(image_idx, image_id, image_relpath, languages, num_captions_per_lang) in the order of the records."""
    rows = records if max_images is None else records.orderBy("line_no").limit(max_images)
    counted = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["language"], F.size(e["captions"]))))
    return dense_ids(rows, "image_idx", "line_no").select(
        "image_idx", "image_id", F.concat("image_id", F.lit(".jpg")).alias("image_relpath"), F.transform("entries", lambda e: e["language"]).alias("languages"), counted.alias("num_captions_per_lang"), "entries"
    )


def build_captions(images: DataFrame) -> DataFrame:
    """(caption_id, image_idx, image_id, language, caption): numbered by image, language place and caption place."""
    spread = images.select("image_idx", "image_id", F.posexplode("entries").alias("_l", "e")).select("image_idx", "image_id", "_l", F.col("e.language").alias("language"), F.posexplode("e.captions").alias("_c", "caption"))
    return dense_ids(spread, "caption_id", "image_idx", "_l", "_c").select("caption_id", "image_idx", "image_id", "language", "caption")


def build_samples(pairs: DataFrame, *order: str, max_images: int | None = None) -> DataFrame:
    """``pairs`` with sample_id in the order of ``order``; pairs without a caption are left out first."""
    kept = pairs.where(F.col("caption").isNotNull() & (F.trim("caption") != ""))
    kept = kept if max_images is None else kept.orderBy(*order).limit(max_images)
    return dense_ids(kept, "sample_id", *order)


def bank_view(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The samples as (images, captions): both ids are the sample's."""
    images = samples.select(F.col("sample_id").alias("image_idx"), F.col("key").alias("image_id"))
    captions = samples.select(F.col("sample_id").alias("caption_id"), F.col("sample_id").alias("image_idx"), F.col("key").alias("image_id"), "language", "caption")
    return images, captions


def normalize_fields(captions: DataFrame, images: DataFrame) -> DataFrame:
    """Captions with the columns language, caption and image_idx, whatever they were called.

    ``lang`` and ``text`` are other names of the first two; image_idx comes from the images
    table by image_id, id or key.  A caption whose image isn't there makes the job fail.
    """
    have = captions.columns
    if "language" not in have and "lang" in have:
        captions = captions.withColumnRenamed("lang", "language")
    if "caption" not in have and "text" in have:
        captions = captions.withColumnRenamed("text", "caption")
    if "image_idx" in have:
        return captions
    key = next(k for k in ("image_id", "id", "key") if k in have)
    ids = images.select(F.col("image_id").alias("_image"), "image_idx")
    joined = captions.join(ids, F.col(key) == F.col("_image"), "left").drop("_image")
    return joined.withColumn("image_idx", F.when(F.col("image_idx").isNull(), F.raise_error(F.concat(F.lit("unknown image "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col("image_idx")))


def dataset_counts(captions: DataFrame) -> DataFrame:
    """One row (n_images, n_captions, languages, num_captions_per_lang)."""
    per = captions.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    lists = per.agg(F.sort_array(F.collect_list("language")).alias("languages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("num_captions_per_lang"))
    return captions.agg(F.countDistinct("image_idx").alias("n_images"), F.count(F.lit(1)).alias("n_captions")).crossJoin(lists)


def map_languages(languages: DataFrame, mapping: DataFrame, available: DataFrame, default: str = "eng_Latn") -> DataFrame:
    """(language, code, is_fallback): the first available candidate of each language.

    A language that is an available code itself maps to itself.  ``mapping`` has (language,
    priority, code).  Without a candidate it is ``default`` if that is available, else the
    first available code, marked as a fallback.
    """
    own = languages.select("language", F.lit(-1).alias("priority"), F.col("language").alias("code"))
    candidates = own.union(languages.join(mapping, "language").select("language", "priority", "code"))
    picked = candidates.join(available.select("code").distinct(), "code", "left_semi").groupBy("language").agg(F.min_by("code", F.struct("priority", "code")).alias("code"))
    other = available.agg(F.min_by("code", F.struct(F.col("code") != default, F.col("code"))).alias("other"))
    return languages.join(picked, "language", "left").crossJoin(other).select("language", F.coalesce("code", "other").alias("code"), F.col("code").isNull().alias("is_fallback"))
