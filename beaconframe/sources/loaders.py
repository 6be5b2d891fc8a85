"""Loading what was built before: indexes, banks, evaluation sets and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.functions.vectors import l2_normalize

from . import captions as cap
from .shards import align_anchors, read_embeddings


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that matches a pattern, is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, root: str, patterns: Sequence[str]) -> str:
    """The first of several layouts that has files under ``root``; an error that names them if none has."""
    for pattern in patterns:
        if exists(spark, f"{root}/{pattern}"):
            return f"{root}/{pattern}"
    raise FileNotFoundError(f"nothing in {root} matches any of {', '.join(patterns)}")


def load_index(spark: SparkSession, root: str, tables: Sequence[str] = ("images", "captions")) -> dict[str, DataFrame]:
    """The tables of an index by name; all of them must be there."""
    missing = [t for t in tables if not exists(spark, f"{root}/{t}")]
    if missing:
        raise FileNotFoundError(f"{root} has no {', '.join(missing)}")
    return {t: spark.read.parquet(f"{root}/{t}") for t in tables}


def load_bank(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(images, captions) of an anchor bank: its own tables, else both from its samples."""
    if exists(spark, f"{root}/images") and exists(spark, f"{root}/captions"):
        found = load_index(spark, root)
        return found["images"], found["captions"]
    return cap.bank_view(load_index(spark, root, ("samples",))["samples"])


def load_vectors(spark: SparkSession, root: str, modality: str, *, normalize: bool = True, **how) -> DataFrame:
    """(id, vec) of one modality, from either layout of its shards."""
    rows = read_embeddings(spark, first_existing(spark, root, (f"embeddings/{modality}", f"{modality}_embs*")), **how)
    return rows.withColumn("vec", l2_normalize(F.col("vec").cast("array<double>"))) if normalize else rows


def load_anchors(spark: SparkSession, root: str, *, below: int | None = None) -> DataFrame:
    """(anchor_id, img_vec, txt_vec) of the anchors that have both, or an error if there are none."""
    both = align_anchors(load_vectors(spark, root, "image"), load_vectors(spark, root, "text"), below=below)
    if not both.limit(1).count():
        raise ValueError(f"{root} has no aligned anchors")
    return both


def load_evaluation(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(captions, images) with vectors; caption columns may have their other names.

    Rows and vectors must be the same ids: a caption or image without a vector is an error.
    """
    index = load_index(spark, root)
    captions = cap.normalize_fields(index["captions"], index["images"])
    out = []
    for rows, key, modality in ((captions, "caption_id", "text"), (index["images"], "image_idx", "image")):
        vectors = load_vectors(spark, root, modality).withColumnRenamed("id", "_id")
        lost = rows.join(vectors, F.col(key) == F.col("_id"), "left_anti").count()
        if lost:
            raise ValueError(f"{lost} rows of {modality} have no vector")
        out.append(rows.join(vectors, F.col(key) == F.col("_id")).drop("_id"))
    return out[0], out[1]


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; values that don't fit their type are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
