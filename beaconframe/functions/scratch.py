"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset, in local mode, a temporary folder, made once a process."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="beaconframe-")
    return _own_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write a slim intermediate result to the shared folder and read it again.

    This cuts the lineage, so a lost executor costs the tasks that read the files and not
    what made them, and a result that is used twice is computed once.  Python workers get
    ``batch`` rows at once, for rows of a few MB; the session's number if it is None.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    usual = conf.get(_BATCH)
    try:
        if batch is not None:
            conf.set(_BATCH, batch)
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, usual)
    return df.sparkSession.read.schema(df.schema).parquet(path)
