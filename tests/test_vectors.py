from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beaconframe.functions import vectors
from beaconframe.functions.names import percents, flat_list
from beaconframe.operators import relrep, topk


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], schema).select(column.alias("x")).first()["x"]


def test_zero_vector_stays_zero(spark):
    assert one(spark, vectors.l2_normalize("v"), v=([0.0, 0.0, 0.0], "array<double>")) == [0.0, 0.0, 0.0]
    assert one(spark, vectors.l2_normalize_additive("v"), v=([0.0], "array<double>")) == [0.0]


def test_normalize_null(spark):
    assert one(spark, vectors.l2_normalize("v"), v=(None, "array<double>")) is None


def test_pools(spark):
    h = ([[1.0, 2.0], [3.0, 6.0], [5.0, 1.0]], "array<array<double>>")
    for mask in ([0, 1, 1], [1, 1, 1]):
        assert one(spark, vectors.last_token_pool("h", "m"), h=h, m=(mask, "array<int>")) == [5.0, 1.0]
    assert one(spark, vectors.last_token_pool("h", "m"), h=h, m=([1, 1, 0], "array<int>")) == [3.0, 6.0]
    assert one(spark, vectors.last_token_pool_right("h", "m"), h=h, m=([1, 1, 0], "array<int>")) == [3.0, 6.0]
    assert one(spark, vectors.last_token_pool_right("h", "m"), h=h, m=([0, 0, 0], "array<int>")) == [1.0, 2.0]
    assert one(spark, vectors.masked_mean_pool("h", "m"), h=h, m=([1, 1, 0], "array<int>")) == [2.0, 4.0]
    assert one(spark, vectors.masked_mean_pool("h"), h=h) == [3.0, 3.0]
    assert one(spark, vectors.cls_pool("h"), h=h) == [1.0, 2.0]


def test_signed_power(spark):
    for p, want in ((3, -0.125), (4, 0.0625)):
        assert one(spark, vectors.process_weight(F.col("s"), "asif", p, None), s=(-0.5, "double")) == want
    assert one(spark, vectors.process_weight(F.col("s"), "none", 9, 0.1), s=(-0.5, "double")) == 0.1
    with pytest.raises(ValueError):
        vectors.process_weight(F.lit(1.0), "other", 1, None)


def test_precision():
    assert vectors.precision("fp32") == "float" and vectors.precision("float64") == "double"
    with pytest.raises(ValueError):
        vectors.precision("bfloat16")


def test_lists():
    assert percents("100, 50 2.5") == [100.0, 50.0, 2.5] and flat_list(["a b", "c,d"]) == ["a", "b", "c", "d"]
    for bad in ("", "0", "101"):
        with pytest.raises(ValueError):
            percents(bad)


def frames(spark, m, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} long, vec array<double>")


def brute(q, a, k):
    s = np.round(q @ a.T, topk.PLACES)
    return {(i, int(j), float(s[i, j]), r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(a)), -s[i]))[:k])}


def test_kernel_and_plan_agree(spark):
    rng = np.random.default_rng(3)
    q, a = rng.standard_normal((30, 5)), rng.standard_normal((50, 5))
    a[10] = a[3]  # a tie: the smaller id comes first
    q, a = q / np.linalg.norm(q, axis=1)[:, None], a / np.linalg.norm(a, axis=1)[:, None]
    want = brute(q, a, 7)
    for f, more in ((topk.top_k_plan, {}), (topk.top_k_blocks, {"query_rows": 8, "anchor_rows": 9})):
        got = {tuple(r) for r in f(frames(spark, q, "id"), frames(spark, a, "anchor_id"), 7, **more).collect()}
        assert {(i, j, r) for i, j, _, r in got} == {(i, j, r) for i, j, _, r in want}
        assert all(abs(x[2] - y[2]) < 1e-8 for x, y in zip(sorted(got), sorted(want), strict=True))
    assert topk.top_k_blocks(frames(spark, q, "id"), frames(spark, a, "anchor_id"), 99).count() == 30 * 50
    # The first k of a longer list are the shorter list.
    longer = topk.top_k(frames(spark, q, "id"), frames(spark, a, "anchor_id"), 12).where("rk <= 7")
    assert {tuple(r)[:2] for r in longer.collect()} == {x[:2] for x in want}


def joined(df):
    """Rows that the nested loops of ``df`` gave in its last run."""
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            left.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
        if node.nodeName() in ("BroadcastNestedLoopJoin", "CartesianProduct"):
            found += node.metrics().apply("numOutputRows").value()
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize(("d", "sent"), [(16, topk.SENT), (16, 0), (60, topk.SENT)])
def test_plan_sorts_only_pairs_that_reach_its_bound(spark, monkeypatch, d, sent):
    monkeypatch.setattr(topk, "SENT", sent)
    rng = np.random.default_rng(6)
    m = rng.standard_normal((400, d))
    m[50:90] = m[7]  # copies: the smaller ids come first, whichever of them a pass reads
    m /= np.linalg.norm(m, axis=1)[:, None]
    best = topk.top_k_plan(frames(spark, m, "id"), frames(spark, m, "anchor_id"), 5)
    assert {(r[0], r[1], r[3]) for r in best.collect()} == {(i, j, r) for i, j, _, r in brute(m, m, 5)}
    assert 400 * 5 <= joined(best) < 400 * 400 / 3


def test_plan_ranks_vectors_without_similarity_last(spark):
    """Null vectors and null components have no similarity, and other lengths neither."""
    rows = [(i, [1.0, i / 100, 0.0]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0]), (62, [None, 1.0, 0.0])]
    for more in ([], [(63, [1.0, 1.0])]):
        q, a = (spark.createDataFrame(rows + more, f"{key} long, vec array<double>") for key in ("id", "anchor_id"))
        got = topk.top_k_plan(q, a, 3).collect()
        assert [(r["anchor_id"], r["s"]) for r in sorted(got, key=lambda r: r["rk"]) if r["id"] == 61] == [(0, None), (1, None), (2, None)]
        assert [r["anchor_id"] for r in sorted(got, key=lambda r: r["rk"]) if r["id"] == 2] == [59, 58, 57]
        assert len(got) == 3 * len(rows + more)


def test_kernel_checks_dimensions(spark):
    with pytest.raises(Exception, match="components"):
        topk.top_k_blocks(frames(spark, np.ones((2, 3)), "id"), frames(spark, np.ones((2, 4)), "anchor_id"), 1).collect()
    with pytest.raises(ValueError):
        topk.top_k(None, None, 0)


def test_subset_kernel(spark):
    rng = np.random.default_rng(5)
    q, a = rng.standard_normal((12, 4)), rng.standard_normal((40, 4))
    sets = [["even"] if i % 2 == 0 else [] for i in range(40)]
    sets = [s + ["all"] for s in sets]
    anchors = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(a, sets, strict=True))], "anchor_id long, vec array<double>, subsets array<string>")
    got = topk.top_k_subsets(frames(spark, q, "id"), anchors, 5, anchor_rows=7).collect()
    assert {(r["id"], r["anchor_id"]) for r in got if r["subset_id"] == "all"} == {x[:2] for x in brute(q, a, 5)}
    even = {(r["id"], r["anchor_id"] // 2) for r in got if r["subset_id"] == "even"}
    assert even == {x[:2] for x in brute(q, a[::2], 5)}


def test_norm_is_asif_with_p_1(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, -0.25, 2), (2, 1, 0.0, 1)], "id long, anchor_id long, s double, rk int")
    a, b = ({(r["id"], r["anchor_id"]): r["w"] for r in relrep.weights(rows, proc=x, p=1).collect()} for x in ("norm", "asif"))
    assert a == b and a[2, 1] == 0.0 and math.isclose(a[1, 1] ** 2 + a[1, 2] ** 2, 1)


def representations(rng, n, anchors, k):
    """Some items without anchors, some with equal ones, weights of both signs."""
    rows = []
    for i in range(n):
        own = rng.choice(anchors, k, replace=False) if i % 5 else [0, 1]
        rows += [(i, int(a), float(w)) for a, w in zip(own, rng.choice([-0.5, 0.25, 0.5, 1.0], k), strict=False) if i % 7 != 3]
    return rows


def test_dense_scores_are_the_filled_ones(spark, monkeypatch):
    monkeypatch.setattr(relrep, "PRODUCTS", 40)
    rng = np.random.default_rng(8)
    c, i = (spark.createDataFrame(representations(rng, n, 12, 4), "id long, anchor_id long, w double") for n in (23, 31))
    captions, images = spark.range(23).withColumnRenamed("id", "caption_id"), spark.range(31).withColumnRenamed("id", "image_idx")
    want = relrep.zero_filled(relrep.scores(c, i), captions, images).select("caption_id", "image_idx", "score")
    got = relrep.dense_scores(c, i, captions, images)
    assert got.count() == 23 * 31 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.columns == want.columns and got.dtypes == want.dtypes


def test_rank_of_blocks_is_the_rank_of_scores(spark, monkeypatch):
    """Two subsets; captions and images without anchors, scores under 0 and equal ones."""
    monkeypatch.setattr(relrep, "PRODUCTS", 40)
    rng = np.random.default_rng(9)
    c, i = (spark.createDataFrame([(s, *r) for s in "ab" for r in representations(rng, n, 12, 4)], "subset_id string, id long, anchor_id long, w double") for n in (23, 31))
    truth = spark.createDataFrame([(s, j, int(rng.integers(31)), "en") for s in "ab" for j in range(23)], "subset_id string, caption_id long, gt long, language string")
    want = relrep.ground_truth_rank(relrep.scores(c, i, ("subset_id",)), truth, F.lit(31), ("subset_id",))
    got = relrep.ground_truth_rank_of(c, i, truth, F.lit(31), "subset_id").select(want.columns)
    assert got.dtypes == want.dtypes and got.count() == 46
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@settings(max_examples=12, deadline=None)
@given(st.data())
def test_analytic_rank_is_the_dense_rank(spark, data):
    n = data.draw(st.integers(1, 6))
    pairs = data.draw(st.dictionaries(st.tuples(st.integers(0, 3), st.integers(0, n - 1)), st.sampled_from([-1.0, -0.5, 0.0, 0.5, 1.0])))
    gts = data.draw(st.lists(st.integers(0, n - 1), min_size=4, max_size=4))
    found = spark.createDataFrame([(c, i, s) for (c, i), s in pairs.items()], "caption_id long, image_idx long, score double")
    truth = spark.createDataFrame([(c, g) for c, g in enumerate(gts)], "caption_id long, gt long")
    got = {r["caption_id"]: r["rank"] for r in relrep.ground_truth_rank(found, truth, F.lit(n)).collect()}
    for c, g in enumerate(gts):
        dense = sorted(range(n), key=lambda i: (-pairs.get((c, i), 0.0), i))
        assert got[c] == dense.index(g) + 1
