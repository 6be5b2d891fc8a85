from __future__ import annotations

import numpy as np
import pytest

from beaconframe.operators import evaluate
from beaconframe.plans import retrieve


def data(spark, images, texts, anchors_i, anchors_t, languages=None):
    n = len(images)
    languages = languages or ["en"] * n
    return retrieve.EvaluationSet(
        captions=spark.createDataFrame([(i, i, languages[i], texts[i].tolist()) for i in range(n)], "caption_id long, image_idx long, language string, vec array<double>"),
        images=spark.createDataFrame([(i, images[i].tolist()) for i in range(n)], "image_idx long, vec array<double>"),
        anchors=spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(anchors_i, anchors_t, strict=True))], "anchor_id long, img_vec array<double>, txt_vec array<double>"),
    )


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    return rng.standard_normal((20, 6)), rng.standard_normal((40, 6)), rng


def config(**more):
    return retrieve.RetrievalConfig(**({"k": 8, "p": 4, "ks": (1, 5, 20), "anchor_n": None} | more))


def brute_recall(images, texts, ai, at, k, p, ks):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]

    def rep(x, a):
        s = np.round(unit(x) @ unit(a).T, 9)
        out = np.zeros_like(s)
        for i, row in enumerate(s):
            best = np.lexsort((np.arange(len(row)), -row))[:k]
            v = row[best] ** p
            out[i, best] = v / max(np.linalg.norm(v), 1e-12)
        return out

    score = np.round(rep(texts, at) @ rep(images, ai).T, 9)
    ranks = [int(np.flatnonzero(np.lexsort((np.arange(len(images)), -row)) == i)[0]) + 1 for i, row in enumerate(score)]
    return [np.mean([r <= x for r in ranks]) for x in ks]


def test_against_numpy(spark, vectors):
    items, bank, rng = vectors
    texts, bank_t = items + 0.4 * rng.standard_normal(items.shape), bank + 0.4 * rng.standard_normal(bank.shape)
    got = {r["language"]: r for r in retrieve.retrieve(data(spark, items, texts, bank, bank_t), config()).collect()}
    assert np.allclose([got["overall"][f"r_at_{k}"] for k in (1, 5, 20)], brute_recall(items, texts, bank, bank_t, 8, 4, (1, 5, 20)))
    assert got["overall"]["r_at_20"] == 1.0 and got["overall"]["r_at_1"] <= got["overall"]["r_at_5"]


def test_same_modalities_find_themselves(spark, vectors):
    items, bank, _ = vectors
    for proc in ("norm", "asif"):
        got = retrieve.retrieve(data(spark, items, items, bank, bank), config(proc=proc)).where("language = 'overall'").first()
        assert got["r_at_1"] == 1.0


def test_orthogonal_map_changes_nothing(spark, vectors):
    items, bank, rng = vectors
    turn = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    texts = items + 0.5
    a, b = (retrieve.retrieve(data(spark, items, t, bank, at), config()).orderBy("language").collect() for t, at in ((texts, bank), (texts @ turn, bank @ turn)))
    assert a == b


def test_overall_is_the_weighted_mean(spark, vectors):
    items, bank, _ = vectors
    rows = retrieve.retrieve(data(spark, items, items[::-1].copy(), bank, bank, ["a"] * 5 + ["b"] * 14 + [None]), config(), mrr=True).collect()
    own = [r for r in rows if r["language"] != evaluate.OVERALL]
    overall = next(r for r in rows if r["language"] == evaluate.OVERALL)
    assert {r["language"] for r in own} == {"a", "b", "None"}
    for c in ("r_at_1", "r_at_5", "mrr"):
        assert abs(sum(r["n"] * r[c] for r in own) / overall["n"] - overall[c]) < 1e-6
    assert overall["r_at_1"] <= overall["mrr"] <= overall["r_at_20"]


def test_sweep_equals_single_runs(spark, vectors):
    items, bank, _ = vectors
    d = data(spark, items, items[:, ::-1].copy(), bank, bank)
    grid = spark.createDataFrame([(4, 2), (8, 4)], "k int, p int")
    swept = {(r["k"], r["p"]): r for r in retrieve.sweep(d, config(), grid).where("language = 'overall'").collect()}
    for k, p in ((4, 2), (8, 4)):
        one = retrieve.retrieve(d, config(k=k, p=p)).where("language = 'overall'").first()
        assert all(one[c] == swept[k, p][c] for c in ("n", "r_at_1", "r_at_5", "r_at_20"))


def test_subsets_equal_single_runs(spark, vectors):
    items, bank, _ = vectors
    d = data(spark, items, items[:, ::-1].copy(), bank, bank)
    subsets = retrieve.first_n_subsets(d.anchors, spark.createDataFrame([(100.0,), (50.0,)], "percentage double"), 40, 8)
    got = {r["subset_id"]: r for r in retrieve.subset_ablation(d, config(), subsets.withColumnRenamed("percentage", "subset_id")).where("language = 'overall'").collect()}
    for name, n in (("100.0", 40), ("50.0", 20)):
        one = retrieve.retrieve(d, config(anchor_n=n)).where("language = 'overall'").first()
        assert all(one[c] == got[name][c] for c in ("n", "r_at_1", "r_at_5"))
    picked = retrieve.EvaluationSet(d.captions, d.images, d.anchors, anchor_subset=d.anchors.where("anchor_id < 20"))
    assert retrieve.retrieve(picked, config()).where("language = 'overall'").first()["r_at_5"] == got["50.0"]["r_at_5"]


def test_checks(spark, vectors):
    items, bank, _ = vectors
    d = data(spark, items, items, bank, bank)
    retrieve.check(d, config())
    for bad, match in ((config(k=41), "anchors"), (config(languages=("xx",)), "no queries")):
        with pytest.raises(ValueError, match=match):
            retrieve.check(d, bad)
    with pytest.raises(ValueError, match="components"):
        retrieve.check(data(spark, items, items[:, :5].copy(), bank, bank), config())
    a, b = config(), config(max_queries=5)
    assert a.fingerprint() != b.fingerprint() and a.fingerprint(index_only=True) == b.fingerprint(index_only=True)


def test_dense_mrr(spark):
    eye = np.eye(3)
    d = data(spark, eye, eye[[1, 0, 2]].copy(), eye, eye)
    got = retrieve.retrieve_dense(d, config(ks=(1, 2))).where("language = 'overall'").first()
    assert got["r_at_1"] == round(1 / 3, 9) and got["r_at_2"] == 1.0 and abs(got["mrr"] - (0.5 + 0.5 + 1) / 3) < 1e-6


def test_random_grid(spark):
    runs = retrieve.random_grid(spark.createDataFrame([(100.0,), (2.5,)], "percentage double"), 3, seed_start=5).collect()
    assert len(runs) == 4 and {r["percentage_label"] for r in runs} == {"100", "2p5"} and min(r["seed"] for r in runs) == 5
