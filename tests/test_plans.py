from __future__ import annotations

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from beaconframe.plans import catalog, encoders, translate
from beaconframe.streaming import arrivals

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(spark):
    return spark.createDataFrame([("a", 0, "en", "one"), ("a", 1, "fr", "deux"), ("b", 2, "xx", "?"), ("b", 3, "fr", "trois")], "image_id string, caption_id long, language string, caption string")


def client():
    def call(texts, source, target):
        if source == "xx":
            raise translate.Rejected(source)
        return [f"{source}>{target}:{x}" for x in texts]

    return call


def test_translate(spark):
    got = {r["caption_id"]: r["translation"] for r in translate.translate(rows(spark), client).collect()}
    assert got == {0: "one", 1: "fr>en:deux", 2: None, 3: "fr>en:trois"}


def test_translated_records(spark):
    both = translate.translate(rows(spark), client, out="t")
    got = {r["image_id"]: r["languages"] for r in translate.translated_records(both, ["t"]).collect()}
    assert got["b"]["xx"]["t"] == [] and got["b"]["fr"]["t"] == ["fr>en:trois"] and set(got["a"]) == {"en", "fr"}


def test_resumes(spark, tmp_path):
    out = str(tmp_path / "out")
    assert translate.append_translations(rows(spark).where("image_id = 'a'"), out, client) == 2
    assert translate.append_translations(rows(spark).union(rows(spark).where("image_id = 'b'")), out, client) == 4
    assert translate.append_translations(rows(spark), out, client) == 0


def test_retries():
    waits, calls = [], []

    def flaky(texts, source, target):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return texts

    assert translate.with_retries(flaky, sleep=waits.append)(["x"], "a", "b") == ["x"] and waits == [2.0, 4.0]
    with pytest.raises(translate.Rejected):
        translate.with_retries(client(), sleep=waits.append)(["x"], "xx", "en")
    assert len(waits) == 2


def lengths():
    def call(texts, language=None):
        return np.array([[len(t), len(language or "")] for t in texts], np.float32)

    return call


def test_encoders(spark):
    data = rows(spark).withColumn("caption", F.when(F.col("caption") != "?", F.col("caption")))
    for by in (False, True):
        got = {r["caption_id"]: r["vec"] for r in encoders.encode(data, "caption", lengths, by_language=by, batch_rows=1).collect()}
        assert got == {0: [3.0, 2.0 * by], 1: [4.0, 2.0 * by], 2: None, 3: [5.0, 2.0 * by]}
    unit = encoders.encode(data, "caption", lengths, normalize=True).where("caption_id = 0").first()["vec"]
    assert unit == [1.0, 0.0]
    assert encoders.check_dimension(lengths, "abc") == 2
    encoders.register("lengths", lambda: lengths())
    assert encoders.make_encoder("unknown", "lengths") is encoders.make_encoder("lengths")
    with pytest.raises(KeyError):
        encoders.make_encoder("unknown")


def tokens():
    """A vector (place + 1, length of the language) for each letter, padded on the left."""

    def call(texts, language=None):
        n = max(map(len, texts))
        mask = np.array([[i >= n - len(t) for i in range(n)] for t in texts])
        hidden = np.array([[[i - n + len(t) + 1, len(language or "")] for i in range(n)] for t in texts], np.float32)
        return hidden, mask

    return call


def test_presets(spark):
    data = rows(spark)
    got = lambda name, evaluation: {r["caption_id"]: r["vec"] for r in encoders.encode_preset(data, "caption", name, tokens, "text", evaluation=evaluation).collect()}
    assert got("nllb-200", False) == {0: [2.0, 0.0], 1: [2.5, 0.0], 2: [1.0, 0.0], 3: [3.0, 0.0]}
    assert got("qwen3", False)[1] == [4.0, 0.0] and got("qwen3", True)[1] == [1.0, 0.0]
    raw = encoders.encode_preset(data, "caption", "qwen3", tokens, "text", evaluation=True, normalize=False)
    assert raw.where("caption_id = 1").first()["vec"] == [4.0, 0.0]
    by_language = got("nllb-200", True)[0]
    assert np.allclose(by_language, np.array([2, 2]) / np.sqrt(8))
    assert encoders.preset("other", "text", evaluation=True).pooling == "cls"
    assert encoders.preset("other", "image", evaluation=True) is encoders.PRESETS["radio"]
    assert encoders.preset("other", "image", evaluation=False) is encoders.PRESETS["dinov3"]
    pooled = encoders.pool([[[1, 2], [3, 4], [9, 9]], [[0, 0], [0, 0], [5, 6]]], [[1, 1, 0], [0, 0, 0]], "last")
    assert pooled.tolist() == [[3, 4], [0, 0]]
    with pytest.raises(ValueError):
        encoders.pool(np.zeros((1, 1, 1)), np.ones((1, 1)), "max")


def test_conversation(spark):
    frame = spark.createDataFrame([("hi", "p.jpg"), (" ", None)], "t string, i string")
    got = frame.select(encoders.conversation(F.lit("do"), F.col("t"), F.col("i")).alias("c")).collect()
    assert [x["type"] for x in got[0]["c"][1]["content"]] == ["image", "text"]
    assert got[1]["c"][1]["content"][0]["text"] == "" and got[0]["c"][0]["content"][0]["text"] == "do"


def test_catalog(spark, tmp_path):
    store, made = catalog.Catalog(spark, f"file://{tmp_path}/cat"), []
    options = {"dataset": "d", "modality": "text", "model": "bge-m3", "n": 3}

    def make():
        made.append(1)
        return spark.range(3)

    assert store.build("emb", options, make).count() == 3 and store.build("emb", options, make).count() == 3 and len(made) == 1
    assert store.build("emb", options | {"n": 4}, make, overwrite=True, rows_per_file=1).count() == 3 and len(made) == 2
    assert store.find("emb", "d", "text", "BGE").count() == 3 and store.entries().count() == 2
    with pytest.raises(KeyError, match="bge-m3"):
        store.find("emb", "d", "text", "other")
    assert catalog.same_rows(spark.range(3), spark.range(2)).collect()[0]["side"] == "left"


def test_results_file(spark, tmp_path):
    from beaconframe.operators.evaluate import recall_table

    table = recall_table(spark.createDataFrame([("en", 1)], "language string, rank long"), [1])
    catalog.write_results(table, str(tmp_path / "r"), {"k": 3, "clamp": None}, [1], "now")
    got = json.loads((tmp_path / "r/results.json").read_text())
    assert got["overall"] == {"R@1": 1.0} and got["run_config"]["k"] == "3" and got["timestamp"] == "now"
    catalog.write_table(table, str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text().startswith("language,n,")


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    score = lambda df: df.withColumn("twice", F.col("id") * 2)
    for n in (5, 8):
        arrivals.score_stream(arrivals.stream_files(spark, source, spark.range(1).schema), score, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        spark.range(5, 8).write.mode("append").parquet(source)
