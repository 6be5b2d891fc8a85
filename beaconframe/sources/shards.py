"""Scans of files: tar shards of image and caption pairs, embeddings, anchor lists, run folders."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIR = "key string, shard string, shard_url string, caption string, language string, meta map<string,string>, image binary"


def read_tar_pairs(spark: SparkSession, path: str, pattern: str = "*.tar", with_images: bool = False) -> DataFrame:
    """One row for each key of the tar shards, by name in each shard: caption, metadata and image.

    Shards are read whole, one a row, so a shard holds under 2 GB.
    """
    return tar_pairs(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path), with_images)


def tar_pairs(files: DataFrame, with_images: bool = False) -> DataFrame:
    """The same of the tar files in ``files`` (path, content).

    A member that can't be read is skipped, a caption that is missing or blank drops its
    key, and metadata that is no JSON object is empty.
    """

    def untar(rows: Iterator) -> Iterator:
        import pandas as pd

        for frame in rows:
            for url, content in zip(frame["path"], frame["content"], strict=True):
                shard = url.rpartition("/")[2]
                found: dict[str, dict] = {}
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for member in tar:
                            stem, _, kind = member.name.rpartition(".")
                            if member.isfile() and kind in ("jpg", "txt", "json"):
                                found.setdefault(stem, {})[kind] = tar.extractfile(member).read()
                except tarfile.TarError:
                    pass
                out = []
                for key in sorted(found):
                    parts = found[key]
                    caption = parts.get("txt", b"").decode("utf-8", "replace")
                    if not caption.strip():
                        continue
                    try:
                        meta = json.loads(parts.get("json", b"{}"))
                        meta = {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in meta.items()} if isinstance(meta, dict) else {}
                    except ValueError:
                        meta = {}
                    out.append((key, shard, url, caption, "en", meta, parts.get("jpg") if with_images else None))
                if out:
                    yield pd.DataFrame(out, columns=["key", "shard", "shard_url", "caption", "language", "meta", "image"])

    return files.select("path", "content").mapInPandas(untar, _PAIR)


def read_embeddings(spark: SparkSession, path: str, *, dim: int | None = None, below: int | None = None, id_col: str = "id") -> DataFrame:
    """(id, vec) of Parquet shards; ids under ``below`` only, and ``dim`` components or an error."""
    rows = spark.read.parquet(path)
    if below is not None:
        rows = rows.where(F.col(id_col) < below)
    if dim is not None:
        rows = rows.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit(f"not {dim} components: id "), F.col(id_col).cast("string")))))
    return rows


def align_anchors(images: DataFrame, texts: DataFrame, *, below: int | None = None) -> DataFrame:
    """(anchor_id, img_vec, txt_vec): the anchors that have both vectors."""
    a = images.select(F.col("id").alias("anchor_id"), F.col("vec").alias("img_vec"))
    b = texts.select(F.col("id").alias("anchor_id"), F.col("vec").alias("txt_vec"))
    both = a.join(b, "anchor_id")
    return both if below is None else both.where(F.col("anchor_id") < below)


def read_anchor_ids(spark: SparkSession, path: str) -> DataFrame:
    """(anchor_id) from Parquet, from JSON (a list, or an object with ``indices``), or from lines of text."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        ids = F.coalesce(F.from_json("value", "indices array<bigint>")["indices"], F.from_json("value", "array<bigint>"))
        return whole.select(F.explode(ids).alias("anchor_id"))
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select(F.col("anchor_id").cast("long").alias("anchor_id"))
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.trim("value").cast("long").alias("anchor_id"))


_RATES = T.MapType(T.StringType(), T.DoubleType())
RESULTS = T.StructType(
    [T.StructField("overall", _RATES), T.StructField("per_language", T.MapType(T.StringType(), _RATES)), T.StructField("n_queries", T.LongType()), T.StructField("run_config", T.MapType(T.StringType(), T.StringType())), T.StructField("timestamp", T.StringType())]
)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, config, results) of all folders under ``root`` with a run_config.json or a results.json.

    A file that is missing or can't be read is null.
    """

    def files(name: str) -> DataFrame:
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
        return found.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("run_dir"), "value")

    configs = files("run_config.json").select("run_dir", F.from_json("value", "map<string,string>").alias("config"))
    results = files("results.json").select("run_dir", F.from_json("value", RESULTS).alias("results"))
    # The union of both kinds of folders, each once.
    folders = configs.select("run_dir").union(results.select("run_dir")).distinct()
    return folders.join(configs, "run_dir", "left").join(results, "run_dir", "left")


def resolve_image_paths(images: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """``images`` (image_idx, image_id, image_relpath) with the path of the first file found.

    ``files`` has (path, relpath).  The relative path comes first, then its stem with other
    extensions, then the id with each extension.
    """
    stem = F.regexp_replace("image_relpath", r"\.[^./]*$", "")
    names = F.array("image_relpath", *(F.concat(stem, F.lit(f".{e}")) for e in extensions), *(F.concat("image_id", F.lit(f".{e}")) for e in extensions))
    tried = images.select("image_idx", F.posexplode(names).alias("priority", "relpath"))
    found = tried.join(files, "relpath").groupBy("image_idx").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return images.join(found, "image_idx", "left")


def content_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha1) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("sha1"))
