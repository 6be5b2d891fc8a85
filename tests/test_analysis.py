from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from beaconframe.operators import analysis, evaluate, select


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(-0.2,), (1.0,), (1.0001,), (-0.21,), (None,)], "s double")
    got = analysis.histogram(rows, "s", lo=-0.2, hi=1.0, bins=80).where("n > 0").orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in got] == [(0, 1), (79, 1)]
    assert analysis.histogram(rows.limit(0), "s", lo=0, hi=1, bins=3).count() == 3


def test_std_and_quantiles(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 4.0), ("c", None)], "g string, x double")
    got = {r["g"]: r["s"] for r in rows.groupBy("g").agg(analysis.sample_std(F.col("x")).alias("s")).collect()}
    assert got["a"] == 0.0 and got["c"] is None and abs(got["b"] ** 2 - 7 / 3) < 1e-12
    assert analysis.quantile_bands(rows, ["g"], "x").where("g = 'b'").first()["q25"] == 1.5


def test_argmax_takes_the_first_of_equal(spark):
    rows = spark.createDataFrame([("g", 3, 1.0), ("g", 1, 1.0), ("g", 0, None)], "g string, id long, x double")
    assert analysis.argmax(rows, ["g"], "x", "id").first()["id"] == 1
    assert analysis.drop_duplicates_keep_first(rows, ["g"], "id").first()["id"] == 0


def test_front(spark):
    points = spark.createDataFrame([(1.0, 5.0), (2.0, 4.0), (2.0, 3.0), (3.0, 4.0), (0.5, float("nan")), (None, 9.0), (0.1, 5.0)], "x double, y double").repartition(3)
    assert sorted((r["x"], r["y"]) for r in analysis.non_dominated(points, "x", "y").collect()) == [(1.0, 5.0), (3.0, 4.0)]


def test_report_order(spark):
    rows = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("a", 0)], "k string, id long")
    assert [r["id"] for r in analysis.in_report_order(rows, ["k"], "id").collect()] == [0, 3, 2, 1]


def test_selection_order_of_steps(spark):
    rows = spark.createDataFrame([(0, 0, "de"), (1, 0, "en"), (2, 0, "en"), (3, 1, None), (4, 1, "en")], "caption_id long, image_idx long, language string")
    ids = lambda df: [r["caption_id"] for r in df.orderBy("caption_id").collect()]
    assert ids(select.select_queries(rows, languages=["en"], first_per_image_language=True, max_queries=2)) == [1, 4]
    assert ids(select.select_queries(rows, languages=["None"])) == [3]
    images = spark.createDataFrame([(0,), (1,), (2,)], "image_idx long")
    assert {r[0]: r[1] for r in select.preferred_caption(rows, images, "en").collect()} == {0: 1, 1: 4, 2: None}
    assert {r[0]: r[1] for r in select.preferred_caption(rows, images, None).collect()} == {0: 0, 1: 3, 2: None}
    assert {r[0]: r[1] for r in select.first_caption(rows, images).collect()} == {0: 0, 1: 3, 2: -1}


def test_subsets(spark):
    anchors = spark.range(100).withColumnRenamed("id", "anchor_id")
    a, b = (select.random_subset(anchors, 10, 4).collect() for _ in range(2))
    assert a == b and len({r[0] for r in a}) == 10 and a != select.random_subset(anchors, 10, 5).collect()
    assert select.random_subset(anchors, 100, 4).count() == 100
    bad = spark.createDataFrame([(1,), (1,), (-3,), (500,)], "anchor_id long")
    assert select.subset_problems(bad, anchors).first().asDict() == {"empty": 0, "negative": 1, "repeated": 1, "unknown": 2}
    assert select.subset_problems(bad.limit(0), anchors).first()["empty"] == 1


def test_resume_and_alignment(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("",)], "id string")
    assert [r[0] for r in select.resume(rows, spark.createDataFrame([("a",), ("a",)], "id string"), "id").collect()] == ["b", "b"]
    left = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "n long, k string")
    right = spark.createDataFrame([(0, "a"), (1, "x")], "n long, k string")
    assert sorted(tuple(r) for r in select.misaligned(left, right, "n", "k").collect()) == [(1, "b", "x"), (2, "c", None)]


def test_aggregate_runs(spark):
    runs = spark.createDataFrame([(50.0, 0, 0, 8, "ok", 0.5), (50.0, 1, 1, 8, "ok", 0.7), (50.0, 2, 2, 8, "failed", None), (100.0, 0, 0, 16, "ok", 0.9)], "percentage double, repeat_idx int, seed int, anchor_n long, status string, r_at_1 double")
    got = {r["percentage"]: r for r in analysis.aggregate_runs(runs, ["r_at_1"], requested=3).collect()}
    assert (got[50.0]["executed_runs"], got[50.0]["ok_runs"], got[50.0]["failed_runs"], got[50.0]["note"]) == (3, 2, 1, "")
    assert got[100.0]["std_r_at_1"] == 0.0 and got[100.0]["note"] and abs(got[50.0]["mean_r_at_1"] - 0.6) < 1e-12


def test_recall_of_nothing_and_document(spark):
    ranks = spark.createDataFrame([("en", 1), ("en", 3), ("de", None)], "language string, rank long")
    table = evaluate.recall_table(ranks, [1, 5], mrr=True)
    got = {r["language"]: r for r in table.collect()}
    assert got["en"]["r_at_1"] == 0.5 and got["de"]["r_at_5"] == 0.0 and got["de"]["mrr"] == 0.0 and got["overall"]["n"] == 3
    doc = evaluate.results_document(table, [1, 5]).first()
    assert doc["n_queries"] == 3 and doc["per_language"]["en"]["R@5"] == 1.0 and round(doc["overall"]["R@1"], 6) == 0.333333
    assert evaluate.recall_table(ranks.limit(0), [1]).where("language = 'overall'").count() <= 1


@pytest.mark.parametrize("values", [["k1", "k2", "k3"]])
def test_pivot(spark, values):
    rows = spark.createDataFrame([("a", "k1", 1.0), ("a", "k1", 2.0), ("b", "k2", 3.0)], "g string, k string, x double")
    got = {r["g"]: (r["k1"], r["k2"], r["k3"]) for r in analysis.pivot_best(rows, "g", "k", values, "x").collect()}
    assert got == {"a": (2.0, None, None), "b": (None, 3.0, None)}
