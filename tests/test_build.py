from __future__ import annotations

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from beaconframe.operators.analysis import status_tallies
from beaconframe.plans import build, catalog, retrieve

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def letters():
    return lambda texts, **_: np.array([[t.count(c) + 0.1 for c in "abcdef"] for t in texts], np.float32)


def test_whole_study(spark, tmp_path):
    store = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    names = ["abc", "bcd", "cde", "def", "aab", "ffe"]
    records = [(i, json.dumps({"image/key": n, "en": {"caption": n * 2}, "de": {"caption": [n + "a", n]}})) for i, n in enumerate(names)]
    images, captions = build.build_index(store, "d", spark.createDataFrame(records, "line_no long, value string"))
    assert images.count() == 6 and captions.count() == 18
    texts = build.build_embeddings(store, "d", "text", "letters", captions, "caption_id", "caption", letters, by_language=True)
    pictures = build.build_embeddings(store, "d", "image", "letters", images, "image_idx", "image_id", letters)
    assert build.build_embeddings(store, "d", "image", "letters", images, "image_idx", "image_id", None).count() == 6
    anchors = pictures.selectExpr("id AS anchor_id", "vec AS img_vec", "vec AS txt_vec")
    data = {("letters", "letters"): build.evaluation_set(captions, texts, pictures, anchors)}
    config = retrieve.RetrievalConfig(k=4, p=2, ks=(1, 3), anchor_n=None)
    postings = build.stored_postings(store, data["letters", "letters"], config)
    assert postings.count() == 24 and build.stored_postings(store, None, retrieve.RetrievalConfig(k=4, p=2, ks=(7,), anchor_n=None, max_queries=1)).count() == 24
    first = build.run_grid(store, data, [2, 4], [2], config, timestamp="t")
    assert {r["status"] for r in first.collect()} == {"ok"}
    again = build.run_grid(store, data, [2, 3], [2], config, timestamp="t", dry_run=True)
    assert {r["status"]: r["n"] for r in status_tallies(again).collect()} == {"skipped": 1, "dry_run": 1}
    bad = {("letters", "letters"): retrieve.EvaluationSet(captions, pictures, anchors)}
    failed = build.run_grid(store, bad, [3], [2], config, timestamp="t").collect()
    assert failed[0]["status"] == "failed" and failed[0]["error"]
    with pytest.raises(Exception, match=".+"):
        build.run_grid(store, bad, [3], [2], config, timestamp="t", continue_on_error=False)

    from beaconframe.sources.shards import RESULTS

    paths = [r["run_dir"] for r in first.collect()]
    results = spark.read.schema(RESULTS).json([f"{p}/results.json" for p in paths])
    assert results.count() == 2 and all(0 <= r["overall"]["R@1"] <= r["overall"]["R@3"] <= 1 for r in results.collect())


def test_reuse_and_empty(spark, tmp_path):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "image_idx long, image_id string")
    build.reuse_images(a, a)
    with pytest.raises(ValueError, match="differ"):
        build.reuse_images(a, a.where("image_idx = 0"))
    with pytest.raises(ValueError, match="no record"):
        build.build_index(catalog.Catalog(spark, f"file://{tmp_path}/c"), "d", spark.createDataFrame([(0, "{}")], "line_no long, value string"))


def test_loaders(spark, tmp_path):
    from beaconframe.sources import loaders

    root = f"file://{tmp_path}/own"
    spark.createDataFrame([(0, "a"), (1, "b")], "image_idx long, image_id string").write.parquet(f"{root}/images")
    with pytest.raises(FileNotFoundError, match="captions"):
        loaders.load_index(spark, root)
    spark.createDataFrame([(0, "a", "en", "x"), (1, "b", "de", "y")], "caption_id long, image_id string, lang string, text string").write.parquet(f"{root}/captions")
    spark.createDataFrame([(i, [3.0, 4.0]) for i in range(2)], "id long, vec array<float>").write.parquet(f"{root}/embeddings/text")
    with pytest.raises(FileNotFoundError, match="image"):
        loaders.load_evaluation(spark, root)
    spark.createDataFrame([(0, [0.0, 2.0])], "id long, vec array<float>").write.parquet(f"{root}/image_embs_0")
    with pytest.raises(ValueError, match="1 rows of image"):
        loaders.load_evaluation(spark, root)
    assert [tuple(r) for r in loaders.load_anchors(spark, root).collect()] == [(0, [0.0, 1.0], [0.6, 0.8])]
    with pytest.raises(ValueError, match="aligned"):
        loaders.load_anchors(spark, root, below=0)
    assert loaders.load_bank(spark, root)[0].count() == 2
    bank = f"file://{tmp_path}/bank"
    spark.createDataFrame([(0, "k", "en", "c")], "sample_id long, key string, language string, caption string").write.parquet(f"{bank}/samples")
    assert loaders.load_bank(spark, bank)[1].first()["caption"] == "c"
    (tmp_path / "r.csv").write_text("k,x\na,0.5\nb,?\n")
    assert [r["x"] for r in loaders.read_report(spark, str(tmp_path / "r.csv"), "k string, x double").collect()] == [0.5, None]
