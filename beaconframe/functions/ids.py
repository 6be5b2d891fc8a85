"""Running totals and dense row numbers in a global order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def running_total(df: DataFrame, name: str, value: str | None, *order: str) -> DataFrame:
    """``df`` with a long column ``name``: the sum of ``value`` (1 if None) over all rows before it in ``order``.

    Rows are range-partitioned by the order and written once with the number of their range,
    so that the sums of the ranges (one row each) and the rows can't disagree about which
    range a row is in.  The order must be total for the result to be reproducible.  Columns
    that begin with ``_range`` are used inside.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    each = F.lit(1) if value is None else F.coalesce(F.col(value).cast("long"), F.lit(0))
    sums = ranged.groupBy("_range").agg(F.sum(each).alias("_range_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_range_sum").over(earlier), F.lit(0)).alias("_range_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(each).over(inside), F.lit(0)) + F.col("_range_offset")
    return ranged.join(offsets, "_range").withColumn(name, total.cast("long")).drop("_range", "_range_offset")


def dense_ids(df: DataFrame, name: str, *order: str, start: int = 0) -> DataFrame:
    """``df`` with a long column ``name``: 0, 1, 2, ... in the order of ``order``, which must be total."""
    numbered = running_total(df, name, None, *order)
    return numbered.withColumn(name, F.col(name) + F.lit(start).cast("long")) if start else numbered
