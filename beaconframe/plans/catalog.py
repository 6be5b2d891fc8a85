"""A catalog of stored tables: where they are, how they were made, and whether to use them again."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model names in use, with the names that people give them.
ALIASES = {"nllb": "nllb-200-3.3B", "nllb-200": "nllb-200-3.3B", "bge": "bge-m3", "qwen3": "qwen3-embed-8b", "dino": "dinov3-vit7b16", "dinov3": "dinov3-vit7b16", "clip": "clip-vit-l14", "radio": "c-radio-v4-h"}
_ENTRY = "key string, kind string, dataset string, modality string, model string, path string, options string, n long"


def fingerprint(options: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()


def resolve_model(name: str, known: list[str] | None = None) -> str:
    """An alias as the model's name; a name that isn't ``known`` raises an error that lists them."""
    found = ALIASES.get(name.strip().lower(), name.strip())
    if known is not None and found not in known:
        raise KeyError(f"no model {name!r}; there are {', '.join(sorted(known))}")
    return found


class Catalog:
    """Tables under ``root``; a table is written once for its options and found by their fingerprint.

    Spark's commit protocol makes a table visible when it is whole: one without ``_SUCCESS``
    isn't used, and is written again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def path(self, kind: str, options: dict[str, Any]) -> str:
        return f"{self.root}/{kind}/{fingerprint(options)[:16]}"

    def is_done(self, kind: str, options: dict[str, Any]) -> bool:
        return self._exists(f"{self.path(kind, options)}/table/_SUCCESS")

    def build(self, kind: str, options: dict[str, Any], make, *, overwrite: bool = False, rows_per_file: int = 0) -> DataFrame:
        """The stored table, made by ``make()`` if there is none with these options."""
        path = f"{self.path(kind, options)}/table"
        if overwrite or not self.is_done(kind, options):
            writer = make().write.mode("overwrite")
            (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)
            entry = [(fingerprint(options), kind, options.get("dataset"), options.get("modality"), options.get("model"), path, json.dumps(options, sort_keys=True, default=str), self.spark.read.parquet(path).count())]
            self.spark.createDataFrame(entry, _ENTRY).coalesce(1).write.mode("overwrite").json(f"{self.path(kind, options)}/entry")
        return self.spark.read.parquet(path)

    def entries(self) -> DataFrame:
        """One row for each stored table."""
        return self.spark.read.schema(_ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(self.root)

    def find(self, kind: str, dataset: str, modality: str, model: str) -> DataFrame:
        """The table of a model by its name or an alias; the first by key if there are several."""
        own = self.entries().where((F.col("kind") == kind) & (F.col("dataset") == dataset) & (F.col("modality") == modality)).collect()
        name = resolve_model(model, [r["model"] for r in own])
        hit = min((r for r in own if r["model"] == name), key=lambda r: r["key"])
        return self.spark.read.parquet(hit["path"])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that only one of two tables has, with the side they are on; none for equal tables."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def write_results(table: DataFrame, path: str, config: dict[str, Any], ks: list[int], timestamp: str) -> None:
    """A run's folder: run_config.json, and results.json with rates overall and by language and the run's options.

    A run is one small document; results.json comes last and is there as a whole or not at all.
    """
    from beaconframe.operators.evaluate import results_document

    options = F.map_from_arrays(F.array(*map(F.lit, config)), F.array(*(F.lit(None if v is None else str(v)).cast("string") for v in config.values())))
    document = results_document(table, ks).withColumn("run_config", options).withColumn("timestamp", F.lit(timestamp)).select(F.to_json(F.struct("*"))).first()[0]
    put_text(table.sparkSession, f"{path}/run_config.json", json.dumps({k: None if v is None else str(v) for k, v in config.items()}))
    put_text(table.sparkSession, f"{path}/results.json", document)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with ``text``, written under another name and then moved, in any file system that Spark knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, waiting = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(waiting, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files.delete(final, False)
    if not files.rename(waiting, final):
        raise OSError(f"{path} could not be written")


def write_table(rows: DataFrame, path: str) -> None:
    """A report table as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
