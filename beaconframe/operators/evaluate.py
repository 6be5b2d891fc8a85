"""Recall at K and truncated mean reciprocal rank, overall and by language, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERALL = "overall"


def recall_aggregates(ks: list[int], mrr: bool, places: int = 9) -> list:
    ks = sorted(ks)
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.round(F.count_if(F.col("rank") <= k) / F.greatest(F.count(F.lit(1)), F.lit(1)), places).alias(f"r_at_{k}") for k in ks]
    if mrr:
        reciprocal = F.when(F.col("rank") <= ks[-1], 1.0 / F.col("rank")).otherwise(0.0)
        out.append(F.round(F.coalesce(F.avg(reciprocal), F.lit(0.0)), places).alias("mrr"))
    return out


def recall_table(ranks: DataFrame, ks: list[int], *, mrr: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, language, n, r_at_K..., mrr) from (keys, language, rank); language ``overall`` sums up all.

    Languages without queries have no row.  A null rank counts as not found, a null language
    as the text ``None``.
    """
    named = ranks.withColumn("language", F.coalesce("language", F.lit("None")))
    sets = [[*keys, "language"], [*keys]]
    out = named.groupingSets(sets, *keys, "language").agg(F.grouping("language").alias("_all"), *recall_aggregates(ks, mrr))
    return out.withColumn("language", F.when(F.col("_all") == 1, F.lit(OVERALL)).otherwise(F.col("language"))).drop("_all")


def results_document(table: DataFrame, ks: list[int]) -> DataFrame:
    """One row (overall, per_language, n_queries) as maps, the form of a results file."""
    rates = F.map_from_arrays(F.array(*(F.lit(f"R@{k}") for k in sorted(ks))), F.array(*(F.col(f"r_at_{k}") for k in sorted(ks))))
    rated = table.select("language", "n", rates.alias("rates"))
    return rated.agg(
        F.any_value(F.when(F.col("language") == OVERALL, F.col("rates")), F.lit(True)).alias("overall"),
        F.map_from_entries(F.collect_list(F.when(F.col("language") != OVERALL, F.struct("language", "rates")))).alias("per_language"),
        F.max(F.when(F.col("language") == OVERALL, F.col("n"))).alias("n_queries"),
    )
