"""Connected components of a link table by alternating star rounds.

Every round hooks nodes to the smallest node they can see (large star, then small star)
until each component is a star around its smallest node.  Links are only ever grouped with
map-side minima, never gathered, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the component's smallest node.

    Links may repeat, point either way, or be loops; null ends are dropped.  No links give
    no rows.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u > v").distinct()
    pairs = materialize(pairs, "links")
    state = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour (or the node).
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
        small = moved.select("v", "m").where("v > m").union(low).toDF("u", "v").distinct()
        pairs = materialize(small, "links")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v"), F.col("v")).distinct())


