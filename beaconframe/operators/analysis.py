"""Histograms, distributions, best configurations and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(values: DataFrame, column: str, *, lo: float, hi: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, lo, hi, n) of all bins: closed on the right at ``hi``, and values outside don't count."""
    x = F.col(column)
    number = F.when(x == hi, bins - 1).otherwise(F.width_bucket(x, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)) - 1).cast("int")
    counted = values.where((x >= lo) & (x <= hi)).groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark, width = values.sparkSession, (hi - lo) / bins
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if keys:
        grid = values.select(*keys).distinct().crossJoin(grid)
    edges = grid.select(*keys, "bin", (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("lo"), (F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(width)).alias("hi"))
    return edges.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def sample_std(x: Column) -> Column:
    """The standard deviation with n - 1; 0 for one value, null for none."""
    return F.coalesce(F.stddev_samp(x), F.when(F.count(x) == 1, 0.0))


def quantile_bands(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, linear quartiles, minimum and maximum of each group."""
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.75).alias("q75"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def best_over(rows: DataFrame, pair: list[str], k: str, p: str, value: str) -> DataFrame:
    """The best value of each pair and k, and of each pair and p, in one pass; the other parameter is null."""
    sets = [[*pair, k], [*pair, p]]
    return rows.groupingSets(sets, *pair, k, p).agg(F.max(value).alias("best"))


def argmax(rows: DataFrame, by: list[str], value: str, row_id: str) -> DataFrame:
    """The row with the largest value of each group, the first of equal ones; null values come last."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), row_id)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_config_by_language(rows: DataFrame, pair: list[str], config: list[str], value: str, others: list[str], row_id: str) -> DataFrame:
    """Means by language of the rows that have their pair's best configuration.

    The best configuration is the one with the largest mean of ``value`` over languages; the
    first by ``row_id`` of equal ones.
    """
    means = rows.groupBy(*pair, *config).agg(F.avg(value).alias("_mean"), F.min(row_id).alias("_first"))
    best = argmax(means, pair, "_mean", "_first").drop("_mean", "_first")
    return rows.join(best, [*pair, *config]).groupBy(*pair, "language").agg(*(F.avg(c).alias(c) for c in [value, *others]))


def drop_duplicates_keep_first(rows: DataFrame, by: list[str], *row_id: str) -> DataFrame:
    """The first row of each group by ``row_id``, which must be total for the result to be reproducible."""
    order = Window.partitionBy(*by).orderBy(*row_id)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def pivot_best(rows: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """One row for each ``row`` and a column for each of ``values``, null where there is none."""
    return rows.groupBy(row).pivot(column, values).agg(F.max(value))


def non_dominated(points: DataFrame, x: str, y: str, margin: float = 1e-12, keys: tuple[str, ...] = ()) -> DataFrame:
    """The points for which no point of larger or equal x has as large a y; points that aren't finite are left out."""
    finite = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))

    def front(rows: DataFrame, by: list) -> DataFrame:
        ahead = Window.partitionBy(*by).orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_best", F.max(y).over(ahead)).where(F.col("_best").isNull() | (F.col(y) > F.col("_best") + margin)).drop("_best")

    # A point that is dominated in its own task is dominated: only the tasks' fronts meet.
    local = front(finite.withColumn("_part", F.spark_partition_id()), [*keys, "_part"]).drop("_part")
    return front(local, [*keys])


def status_tallies(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def aggregate_runs(runs: DataFrame, metrics: list[str], requested: int, by: str = "percentage") -> DataFrame:
    """Random-subset runs by percentage: counts, first anchor_n, mean and deviation of the runs that are ok."""
    ok = F.col("status") == "ok"
    aggs = [
        F.min_by("anchor_n", F.struct("repeat_idx", "seed")).alias("anchor_n"), F.count(F.lit(1)).alias("executed_runs"), F.count_if(ok).alias("ok_runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"),
    ]
    for m in metrics:
        value = F.when(ok, F.col(m))
        aggs += [F.avg(value).alias(f"mean_{m}"), sample_std(value).alias(f"std_{m}")]
    note = F.when((F.col(by) == 100) & (F.col("executed_runs") == 1) & F.lit(requested > 1), "deterministic: run once").otherwise("")
    return runs.groupBy(by).agg(*aggs).withColumn("note", note)


def summary_tables(runs: DataFrame, fields: list[str], ks: list[int]) -> tuple[DataFrame, DataFrame]:
    """The wide table of runs and the long one by language, from (run_dir, config, results).

    The configuration is the run's own, else the one inside its results.  A run without
    results has the status ``missing`` and null metrics.
    """
    config = F.coalesce("config", F.col("results.run_config"))
    base = runs.select(
        "run_dir", F.regexp_extract("run_dir", "([^/]*)$", 1).alias("run_name"), F.when(F.col("results").isNull(), "missing").otherwise("ok").alias("status"), *(config[f].alias(f) for f in fields),
        *(F.col("results.overall")[f"R@{k}"].alias(f"overall_r_at_{k}") for k in ks), F.col("results.n_queries").alias("n_queries"), F.col("results.per_language").alias("per_language"),
    )
    wide = base.drop("per_language")
    long = base.select("run_dir", "run_name", *fields, F.explode("per_language").alias("language", "rates")).select("run_dir", "run_name", *fields, "language", *(F.col("rates")[f"R@{k}"].alias(f"r_at_{k}") for k in ks))
    return wide, long


def in_report_order(rows: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Sorted by several columns, missing values last, then in the given order."""
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in columns), row_id)
