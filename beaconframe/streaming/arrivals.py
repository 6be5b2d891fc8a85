"""Captions that arrive as a stream, against a fixed index (an addition to the batch library).

Each micro-batch is scored by the same plan as a batch run, and appended.  The checkpoint
makes a restart go on where it stopped; batches are written under their number, so one that
is run again replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, path: str, schema, *, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(captions: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write ``score(batch)`` of each micro-batch to ``out``, all there is now, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return captions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
