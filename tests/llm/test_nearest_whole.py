"""Nodes that the first leaves leave alone, and queries that the search can't answer in full."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from test_corpus_operators import plain_nearest, run_nearest

from beaconframe.llm import ann


def test_a_lone_vector_has_all_its_neighbours(spark):
    """All but one vector lie close around one direction, the query on the other side of every plane."""
    rng = np.random.default_rng(5)
    mean = rng.standard_normal(16)
    rows = [(20 * i + 1, (mean + 0.01 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(2600)]
    rows.append((0, (-mean).astype(np.float32).tolist()))
    got, want = run_nearest(spark, rows), plain_nearest(rows, 20)
    assert got.keys() == {0} and len(got[0]) == len(want[0]) == 20


def test_comparison_with_all_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)).astype(np.float32))]
    nodes = spark.createDataFrame(rows, "id long, vec array<float>")
    got = {}
    for r in ann._compare_all(nodes.where("id % 20 = 0").select(F.col("id").alias("query")), nodes, 21).collect():
        got.setdefault(r["query"], set()).add(r["other"])
    for q, best in plain_nearest(rows, 19).items():
        assert {i for i, _ in best} <= got[q]
