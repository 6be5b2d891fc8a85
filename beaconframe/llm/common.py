"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from beaconframe.functions.scratch import materialize, scratch_path, shared_dir

__all__ = ["ASCII_SPACE", "WORD", "batches", "column", "materialize", "scratch_path", "shared_dir", "table"]

#: Java and Python regular expression of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The ASCII white space that ``bytes.split()`` and ``bytes.strip()`` also use.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batches(rows: Iterator[pa.RecordBatch], size: int = 64) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few long texts are decoded at a time."""
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
