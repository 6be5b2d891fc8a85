"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
from test_corpus_operators import DOCS, plain_lines
from test_text_operators import PROSE, check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    rng = np.random.default_rng(21)
    words = PROSE.split()
    shared = "This line is part of the page layout and of nothing else."
    rows = []
    for i in range(60):
        at = rng.integers(0, 40)
        text = " ".join(words[at : at + 70]) + f" and the {i} of it" + ("\n" + shared if i % 3 == 0 else "")
        rows.append((i, text, "en", "ab"[i % 2], len(text)))
    rows += [(100 + i, rows[i][1], "en", "a", 1) for i in range(10)]
    rows += [(200, "%%% ### " * 100, "en", "b", 1), (201, None, "en", None, 0), (202, "too short", None, "a", 9), (203, "same same same same same same " * 9, "en", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def plain_kept(rows, width=5, similarity=0.8):
    """The smallest id of each group of texts whose sets of shingles are alike."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= similarity * len(x | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i, g in enumerate(group) if g == one) for one in set(group))


def test_stages(spark):
    docs, sizes = corpus(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, "")
        if name == "quality_rules":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in out.collect()} == {200, 201, 202, 203}
        elif name == "line_dedup":
            want = plain_lines([(r["doc_id"], r["text"]) for r in before])
            import hashlib

            got = sorted(((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()), key=str)
            assert got == sorted(((d, h) for d, _, _, h in want), key=str) and sum(n for _, _, n, _ in want) >= 15
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "near_dedup":
            assert sorted(r["doc_id"] for r in out.collect()) == plain_kept([(r["doc_id"], r["text"]) for r in before])
        elif name == "mix_sources":
            rows = Counter(r["doc_id"] for r in out.collect())
            assert max(rows.values()) <= 3 and set(rows) <= {r["doc_id"] for r in before}
        else:
            one_each = docs.dropDuplicates(["doc_id"])
            check_packing(spark, one_each)
            assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in before}
        if name != "pack_sequences":
            assert out.columns == COLUMNS
        sizes.append(out.count())
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert all(sizes)


def test_run_on_tables(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.selectExpr("max(length)").first()[0] <= 1024
    corpus(spark).limit(0).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_extra_columns_pass(spark):
    docs = spark.createDataFrame([(i, PROSE, "en", "s", 1, 2, 3, 4) for i in range(3)], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
    assert docs.count() >= 1
