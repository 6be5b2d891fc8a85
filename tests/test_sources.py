from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from beaconframe.functions.ids import dense_ids, running_total
from beaconframe.functions.names import file_safe, infer_model_type, numeric, percent_label, percent_to_count, short_title
from beaconframe.sources import captions as cap
from beaconframe.sources import shards


def lines(spark, *records):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)], "line_no long, value string")


def entries(spark, record, **how):
    rows = cap.parse_records(lines(spark, record), **how).collect()
    return {e["language"]: e["captions"] for r in rows for e in r["entries"]}


def test_caption_forms(spark):
    record = {"image/key": "a", "image/x": {"caption": "no"}, "zz": {"caption": "one"}, "en": {"captions": ["x", 3, " ", "y", None, {"z": 1}]}, "de": {}, "fr": "text", "it": {"caption": []}}
    assert entries(spark, record) == {"zz": ["one"], "en": ["x", " ", "y"]}
    assert entries(spark, record, drop_blank=True) == {"zz": ["one"], "en": ["x", "y"]}


def test_record_rules(spark):
    got = cap.parse_records(lines(spark, {"image_id": "b", "en": {"caption": "x"}}, {"en": {"caption": "x"}}, {"image/key": "c", "en": {"caption": []}}, "not json", {"image/key": "", "id": "d", "fr": {"caption": "y"}}))
    assert [r["image_id"] for r in got.orderBy("line_no").collect()] == ["b", "d"]


def test_missing_translation_drops_the_language(spark):
    record = {"image/key": "a", "en": {"source_caption": ["s"], "translation_tllm": ["t"]}, "mi": {"source_caption": ["s"], "translation_tllm": []}}
    assert entries(spark, record, field="translation_tllm", drop_blank=True) == {"en": ["t"]}


def test_index_keeps_the_order_of_keys(spark):
    records = cap.parse_records(lines(spark, {"image/key": "a", "zz": {"caption": ["1", "2"]}, "aa": {"caption": "3"}}, {"image/key": "b", "aa": {"caption": "4"}}))
    images = cap.build_images(records)
    assert [tuple(r) for r in images.select("image_idx", "image_id", "languages").orderBy("image_idx").collect()] == [(0, "a", ["zz", "aa"]), (1, "b", ["aa"])]
    assert images.orderBy("image_idx").first()["num_captions_per_lang"] == {"zz": 2, "aa": 1}
    captions = cap.build_captions(images).orderBy("caption_id").collect()
    assert [r["caption"] for r in captions] == ["1", "2", "3", "4"] and [r["caption_id"] for r in captions] == [0, 1, 2, 3]
    assert cap.build_images(records, max_images=1).count() == 1
    assert cap.with_images(records, spark.createDataFrame([("b",)], "image_id string")).count() == 1


def test_read_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"image/key": "a", "en": {"caption": "q"}}\n\n   \n{"image/key": "b", "en": {"caption": "r"}}\n')
    rows = cap.parse_records(cap.read_lines(spark, str(tmp_path / "x.jsonl"))).orderBy("line_no").collect()
    assert [r["image_id"] for r in rows] == ["a", "b"]


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    assert all(r["n"] == r["x"] for r in dense_ids(rows, "n", "x").collect())
    assert dense_ids(rows.limit(0), "n", "x").count() == 0


def test_fields_and_unknown_images(spark):
    images = spark.createDataFrame([("a", 5)], "image_id string, image_idx long")
    rows = cap.normalize_fields(spark.createDataFrame([("a", "en", "t")], "id string, lang string, text string"), images)
    assert rows.select("image_idx", "language", "caption").first() == (5, "en", "t")
    with pytest.raises(Exception, match="unknown image"):
        cap.normalize_fields(spark.createDataFrame([("z", "en", "t")], "id string, lang string, text string"), images).collect()


def test_language_map(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    mapping = frame([("en", 0, "eng_Latn"), ("fr", 0, "none"), ("fr", 1, "fra_Latn")], "language string, priority int, code string")
    available = frame([("eng_Latn",), ("fra_Latn",)], "code string")
    got = cap.map_languages(frame([("en",), ("fr",), ("da",), ("fra_Latn",)], "language string"), mapping, available).collect()
    assert {r["language"]: (r["code"], r["is_fallback"]) for r in got} == {"en": ("eng_Latn", False), "fr": ("fra_Latn", False), "da": ("eng_Latn", True), "fra_Latn": ("fra_Latn", False)}


def test_tar_pairs(spark, tmp_path):
    with tarfile.open(tmp_path / "0.tar", "w") as tar:
        for name, content in (("b.txt", b"two"), ("a.txt", "eins ö".encode()), ("a.json", b'{"k": 1}'), ("a.jpg", b"\xff"), ("c.txt", b" "), ("b.json", b"broken")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    (tmp_path / "1.tar").write_bytes(b"no tar")
    rows = shards.read_tar_pairs(spark, str(tmp_path), with_images=True).orderBy("key").collect()
    assert [(r["key"], r["shard"], r["caption"], r["meta"]) for r in rows] == [("a", "0.tar", "eins ö", {"k": "1"}), ("b", "0.tar", "two", {})]
    assert bytes(rows[0]["image"]) == b"\xff" and rows[1]["image"] is None
    samples = cap.build_samples(shards.read_tar_pairs(spark, str(tmp_path)), "shard", "key")
    assert [r["sample_id"] for r in samples.orderBy("key").collect()] == [0, 1]
    assert cap.bank_view(samples)[1].columns == ["caption_id", "image_idx", "image_id", "language", "caption"]


def test_anchor_ids(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3\n\n 1 \n")
    (tmp_path / "b.json").write_text('{"indices": [4, 2]}')
    (tmp_path / "c.json").write_text("[7]")
    got = [sorted(r[0] for r in shards.read_anchor_ids(spark, str(tmp_path / n)).collect()) for n in ("a.txt", "b.json", "c.json")]
    assert got == [[1, 3], [2, 4], [7]]


def test_embeddings(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id long, vec array<float>").write.parquet(str(tmp_path / "e"))
    assert shards.read_embeddings(spark, str(tmp_path / "e"), dim=2, below=4).count() == 4
    with pytest.raises(Exception, match="not 3 components"):
        shards.read_embeddings(spark, str(tmp_path / "e"), dim=3).collect()
    both = shards.read_embeddings(spark, str(tmp_path / "e"))
    assert shards.align_anchors(both, both.where("id > 5"), below=8).count() == 2


def test_runs(spark, tmp_path):
    for name, files in (("r1", {"run_config.json": {"k": 5}, "results.json": {"overall": {"R@1": 0.5}, "per_language": {"en": {"R@1": 0.5}}, "n_queries": 4}}), ("deep/r2", {"run_config.json": {"k": 7}}), ("r3", {"results.json": {"overall": {"R@1": 1.0}, "run_config": {"k": "9"}}})):
        (tmp_path / name).mkdir(parents=True)
        for f, x in files.items():
            (tmp_path / name / f).write_text(json.dumps(x))
    from beaconframe.operators.analysis import summary_tables

    wide, long = summary_tables(shards.read_runs(spark, str(tmp_path)), ["k"], [1])
    got = {r["run_name"]: (r["status"], r["k"], r["overall_r_at_1"]) for r in wide.collect()}
    assert got == {"r1": ("ok", "5", 0.5), "r2": ("missing", "7", None), "r3": ("ok", "9", 1.0)}
    assert [tuple(r)[1:] for r in long.collect()] == [("r1", "5", "en", 0.5)]


def test_image_paths(spark):
    images = spark.createDataFrame([(0, "a", "x/a.jpg"), (1, "b", "x/b.jpg"), (2, "c", "c.jpg")], "image_idx long, image_id string, image_relpath string")
    files = spark.createDataFrame([("/r/x/a.jpg", "x/a.jpg"), ("/r/x/b.png", "x/b.png"), ("/r/b.jpg", "b.jpg")], "path string, relpath string")
    got = {r["image_idx"]: r["path"] for r in shards.resolve_image_paths(images, files).collect()}
    assert got == {0: "/r/x/a.jpg", 1: "/r/x/b.png", 2: None}


def test_names(spark):
    row = spark.range(1).select(
        file_safe(F.lit("//a b/ü")).alias("a"), file_safe(F.lit("??")).alias("b"), short_title(F.lit("x" * 121)).alias("c"), percent_label(F.lit(2.5)).alias("d"), percent_label(F.lit(50.0)).alias("e"),
        numeric(F.lit("x")).alias("f"), infer_model_type(F.lit("a-CLIP-b"), F.lit("")).alias("g"), infer_model_type(F.lit("clip-qwen"), F.lit("own")).alias("h"),
    ).first()
    assert tuple(row) == ("a_b", "model", "x" * 117 + "...", "2p5", "50", None, "clip_dense_retrieval_baseline", "own")
    pct = spark.createDataFrame([(0.25,), (0.75,), (0.35,)], "p double").select(percent_to_count(F.lit(1000), F.col("p"), 1).alias("n")).collect()
    assert [r["n"] for r in pct] == [2, 8, 3]


def test_lines_in_the_order_of_files(spark, tmp_path):
    """Larger files are read first; the numbers follow the names."""
    for name, n in (("a", 1), ("b", 50), ("c", 7)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i}\n\n" for i in range(n)))
    got = [(r["line_no"], r["value"]) for r in cap.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == list(enumerate(f"{name}{i}" for name, n in (("a", 1), ("b", 50), ("c", 7)) for i in range(n)))


def test_kinds_of_captions(spark):
    rows = lines(spark, {"id": 1, "en": {"caption": "[photo] a cat"}, "de": {"caption": "{x}"}, "fr": "{\"caption\": \"no\"}", "es": {"caption": ["a", 1, None, "b"]}, "it": {"caption": 5}, "pt": {"caption": [], "captions": "c"}})
    got = cap.parse_records(rows).first()
    assert got["image_id"] == "1"
    assert [(e["language"], e["captions"]) for e in got["entries"]] == [("en", ["[photo] a cat"]), ("de", ["{x}"]), ("es", ["a", "b"]), ("pt", ["c"])]


def test_numbers_over_many_ranges(spark):
    """Wide rows, adaptive plans that merge small ranges, and ids that equal their ranks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        n = 200_000
        rows = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("at"), F.sha2(F.col("id").cast("string"), 512).alias("wide"), F.sha2(F.col("id").cast("string"), 256).alias("more")).repartition(13)
        got = dense_ids(rows, "n", "at").agg(F.count("*"), F.countDistinct("n"), F.count_if(F.col("n") != F.col("at")), F.min("n"), F.max("n")).first()
        assert tuple(got) == (n, n, 0, 0, n - 1)
        totals = running_total(rows.limit(1000).select("at"), "before", "at", "at").orderBy("at").collect()
        assert [r["before"] for r in totals] == [sum(x["at"] for x in totals[:i]) for i in range(1000)]
        assert dense_ids(rows.limit(0), "n", "at").count() == 0 and dense_ids(rows.limit(3), "n", "at", start=5).agg(F.min("n")).first()[0] == 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
