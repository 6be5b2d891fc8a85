"""Operators that look at the whole corpus, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from beaconframe.llm import ann, components, line_dedup, mixing, shard_store, simhash
from beaconframe.llm.queries import compacted

WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, high long, size int"


def docs(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source), with columns that have names used inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 5, 5, 5) for r in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- lines --------------------------------------------------------------------------------------


def plain_lines(rows):
    keys = []
    for doc, text in rows:
        keys.append([lower(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")])
    holders = {}
    for (doc, _), own in zip(rows, keys, strict=True):
        for k in set(own):
            if len(k) >= 40:
                holders.setdefault(k, []).append(doc)
    out = []
    for (doc, text), own in zip(rows, keys, strict=True):
        keep = []
        for line, k in zip((text or "").split("\n"), own, strict=True):
            by = holders.get(k, [])
            known = [d for d in by if d is not None]
            if not (len(by) >= 5 and known and doc != max(known)):
                keep.append(line)
        out.append((doc, len(own), len(own) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


LONG = ["Shared line number one, long enough to count as such.", "É" * 39, "É" * 40, "x" * 39, "Y" * 40, "another passage that is in many of the documents here"]


def line_rows():
    rng = np.random.default_rng(4)
    rows = [(None, LONG[0]), (None, None), (3, None), (4, ""), (5, "\n\n"), (6, LONG[0] + "\n" + LONG[0].upper() + "\n  " + LONG[0] + "\t\r"), (6, LONG[0]), (7, "z" * 100_000 + "\n" + LONG[4])]
    for i in range(10, 60):
        own = [LONG[k] if rng.random() < 0.5 else f"short {i} {k}" for k in rng.integers(0, len(LONG), rng.integers(0, 7))]
        rows.append((i, "\n".join(own)))
    rows += [(60 + i, "only rows without an id hold this line, which is long") for i in range(3)] + [(None, "no row with an id holds this one line, which is long")] * 6
    return rows


@pytest.mark.parametrize(("size", "per_shard"), [(1 << 20, 100), (1 << 20, 2), (0, 2)])
def test_lines(spark, size, per_shard):
    rows = line_rows()
    got = line_dedup.drop_repeated_lines(docs(spark, rows), digest=True, broadcast_bytes=size, keys_per_shard=per_shard).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_lines(rows)


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_lines_keep_columns(spark, size):
    rows = docs(spark, line_rows())
    got = line_dedup.drop_repeated_lines(rows, broadcast_bytes=size)
    assert got.schema.simpleString() == rows.schema.simpleString() and got.count() == rows.count()
    assert got.where("text IS NULL").count() == 2 and got.where("high = 5 AND fp = 5").count() == rows.count()
    assert line_dedup.drop_repeated_lines(docs(spark, []), digest=True, broadcast_bytes=size).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(8).integers(0, 2**63, 20_000).astype(np.uint64)
    levels, bits = line_dedup.PerfectHash.build(keys)
    h = line_dedup.PerfectHash(levels, bits)
    assert sorted(h.slots(keys).tolist()) == list(range(len(np.unique(keys)))) and 8 * len(bits) / len(keys) < 5
    assert line_dedup.PerfectHash(*line_dedup.PerfectHash.build(keys[:0])).slots(keys[:3]).tolist() == [-1] * 3


# --- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    words = [lower(w) for w in WORDS.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, ids, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [low.get(find(i)) for i in range(len(fps))]


def near_rows():
    rng = np.random.default_rng(6)
    base = [list(rng.choice([f"w{i}" for i in range(300)], 200)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n"), (None, "solo text"), (None, "x"), (3, "x"), (3, "x"), (4, "A b"), (5, "a B"), (6, "big " * 30_000)]
    for i in range(10, 90):
        words = list(base[i % 6])
        for at in rng.integers(0, 200, rng.integers(0, 3)):
            words[at] = f"new{rng.integers(0, 5)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("bits", "bucket"), [(2, 2048), (2, 2), (3, 2), (1, 3), (0, 9), (5, 2048)])
def test_simhash(spark, bits, bucket):
    rows = near_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, plain_groups(fps, [d for d, _ in rows], bits), strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(docs(spark, rows), max_bits=bits, max_bucket=bucket).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("bits", "bucket"), [(2, 4), (3, 6), (2, 2048)])
def test_links_of_close_fingerprints(spark, bits, bucket):
    """Many fingerprints in a small ball: large buckets lose no link, and don't list all pairs."""
    rng = np.random.default_rng(bits)
    centre = rng.integers(0, 2**63, 4).tolist()
    fps = sorted({c ^ sum(1 << int(b) for b in rng.integers(0, 64, n)) for c in centre for n in rng.integers(0, 4, 60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits=bits, max_bucket=bucket)
    groups = {r["node"]: r["root"] for r in components.components(links).collect()}
    mine = [groups.get(f, f) for f in signed]
    want = plain_groups(fps, list(range(len(fps))), bits)
    assert [mine.index(m) for m in mine] == [want.index(w) for w in want]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= bits for a, b in links.collect())


def test_keep_one_each(spark):
    rows = docs(spark, [(5, "same words here"), (2, "same words here"), (9, "other words there"), (None, "same words here"), (2, "same words here")])
    kept = simhash.keep_one_each(rows)
    assert kept.columns == rows.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["2", "2", "9", "None"]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300), (None, 1)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {n: n for pair in links for n in pair if n is not None}
    for _ in range(len(low)):
        for a, b in links:
            if a is not None and b is not None:
                low[a] = low[b] = min(low[a], low[b])
    lonely = {n for n, r in low.items() if list(low.values()).count(r) == 1}
    assert got == {n: r for n, r in low.items() if n not in lonely}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing -------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight, total, stopped = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        level = (total - sum(stopped.values())) / max(1, sum(w for s, w in weight.items() if s not in stopped))
        over = {s: 3 * sizes[s] for s in names if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: float(stopped.get(s, level * weight[s])) for s in names}
        stopped |= over


def mix_rows(seed=1, n=400):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "B", "é", "z", None, "tiny", "nothing"]
    chance = np.array([0.35, 0.2, 0.1, 0.1, 0.1, 0.1, 0.03, 0.02])
    rows = []
    for i in range(n):
        s = names[rng.choice(len(names), p=chance)]
        rows.append((i, None if s == "nothing" and i % 2 else "" if s == "nothing" else " ".join(["w"] * int(rng.integers(1, 60))), s))
    return rows


@pytest.mark.parametrize("cell", [1000, 5])
def test_mix(spark, cell):
    rows = mix_rows()
    got = [(r["doc_id"], *r["mix"]) for r in mixing.mix(docs(spark, rows), slim=True, cell_rows=cell).collect()]
    again = [(r["doc_id"], *r["mix"]) for r in mixing.mix(docs(spark, rows).repartition(7), cell_rows=cell).select("doc_id", "mix").collect()]
    assert sorted(got) == sorted(again)
    size = {d: len(WORDS.findall(t or "")) for d, t, _ in rows}
    sizes = Counter()
    for d, _, s in rows:
        sizes[s] += size[d]
    targets, of, taken = plain_targets(dict(sizes)), {d: s for d, _, s in rows}, Counter()
    for doc, own, source_size, target, copies, words in got:
        assert own == size[doc] and source_size == sizes[of[doc]] and abs(target - targets[of[doc]]) < 1e-6
        assert words == copies * own <= 3 * own
        # Whole copies are certain, and one more is drawn.
        assert copies - int(target / source_size if source_size else 0) in (0, 1)
        taken[of[doc]] += words
    assert all(abs(taken[s] - targets[s]) <= 30 for s in targets) and abs(sum(targets.values()) - sum(sizes.values())) < 1e-6


def test_mix_weights_and_edges(spark):
    rows = mix_rows(3, 300)
    heavy = docs(spark, rows).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(1.0)))
    got = mixing.mix(heavy, weight_col="w").select("doc_id", "mix.*").collect()
    rate = lambda f: np.mean([r["copies"] for r in got if f(r["doc_id"])])
    assert rate(lambda i: i % 2 == 0) > 1.5 * rate(lambda i: i % 2 and i % 5) and rate(lambda i: i % 2 and i % 5 == 0) == 0
    assert mixing.mix(docs(spark, [])).count() == 0
    named = mixing.mix(docs(spark, rows[:9]).withColumn("mix", F.lit(1)).withColumn("place", F.lit(2)).withColumn("a.b", F.lit(3)))
    assert named.columns[-3:] == ["place", "a.b", "mix"] and named.select("mix.copies").count() == 9
    same = mixing.mix(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, None, None)])).select("doc_id", "mix.*").collect()
    assert [r["copies"] for r in same if r["doc_id"] == 1] == [1, 1]
    again = mixing.repeat_documents(docs(spark, rows))
    assert again.columns == docs(spark, []).columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs(spark, rows), slim=True).select("doc_id", "mix.copies").collect()}
    assert Counter(r["doc_id"] for r in again.collect()) == Counter({d: n for d, n in copies.items() if n})


def test_inclusion_rates(spark):
    """Over many seeds each document is drawn about as often as its inclusion probability says."""
    rows = [(i, "w " * (1 + i % 4), "a" if i < 30 else "b") for i in range(60)]
    frame, n = docs(spark, rows), Counter()
    for seed in range(12):
        for r in mixing.mix(frame, slim=True, seed=seed).select("doc_id", "mix.copies").collect():
            n[r["doc_id"]] += r["copies"]
    a = [n[i] / 12 for i in range(30)]
    assert abs(np.mean(a) - 2 / 3) < 0.1 and max(a) <= 1.0


# --- the shard store ------------------------------------------------------------------------------


def store(spark, tmp_path, **more):
    return shard_store.ShardStore(spark, f"file://{tmp_path}/store", **({"target_bytes": 60_000, "smallest": 2_000} | more))


def test_compaction(spark, tmp_path):
    rows = docs(spark, [(i, hashlib.sha256(str(i).encode()).hexdigest() * (i % 30)) for i in range(2000)] + [(None, None), (1, ""), (1, "")])
    parts = [rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(9)) == k) for k in range(9)]
    s = store(spark, tmp_path)
    for part in parts:
        s.append(part)
        s.compact()
        s.vacuum()
    assert s.read().exceptAll(rows).count() == 0 and rows.exceptAll(s.read()).count() == 0
    live = s.manifest()["shards"]
    assert not s.due(live) and sum(x.rows for x in live) == 2003
    assert len(live) < 9 * 4 and max(x.bytes for x in live) > 30_000
    on_disk = {p.name for p in (tmp_path / "store/data").glob("*/*.parquet")}
    assert {x.path.rpartition("/")[2] for x in live} <= on_disk


def test_versions_and_conflicts(spark, tmp_path):
    s = store(spark, tmp_path)
    with pytest.raises(ValueError):
        s.read()
    first = s.append(docs(spark, [(1, "a")]))
    base = s.manifest()
    second = s.append(docs(spark, [(2, "b")]))
    assert (first, second) == (1, 2) and s.read(1).count() == 1 and s.read().count() == 2
    with pytest.raises(shard_store.VersionConflict):
        s._commit(base, base["schema"], [])
    assert s.manifest()["version"] == 2 and s.read().count() == 2
    # Files that no manifest lists, as of a lost writer, are never seen, and vacuum drops them.
    s._write(docs(spark, [(3, "c")]))
    assert s.read().count() == 2 and s.vacuum() >= 1 and s.read().count() == 2 and s.versions() == [2]
    with pytest.raises(ValueError, match="columns"):
        s.append(spark.range(1))
    assert s.append(docs(spark, [])) == 3 and s.read().count() == 2


def test_empty_store_of_no_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.ingest(docs(spark, []), shard_rows=10) == 1
    assert s.read().count() == 0 and s.compact() == 1


def test_the_query_merges(spark, tmp_path):
    """One file without partitions still arrives in small shards, and most of them are merged."""
    rows = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(640)], "doc_id long, text string").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    s = compacted(spark.read.parquet(str(tmp_path / "in")), f"file://{tmp_path}/store")
    found = s.manifest()
    assert found["version"] > 4 and len(found["shards"]) < 16 and max(x.rows for x in found["shards"]) > 100
    assert sorted((r["doc_id"], r["text"]) for r in s.read().collect()) == sorted((r["doc_id"], r["text"]) for r in rows.collect())
    on_disk = {str(p.relative_to(tmp_path / "store")) for p in (tmp_path / "store/data").rglob("*.parquet")}
    assert on_disk == {x.path for x in found["shards"]}


def test_tiers(spark, tmp_path):
    s = store(spark, tmp_path)
    assert [s.tier(n) for n in (1, 2000, 2001, 8000, 8001)] == [0, 0, 1, 1, 2]
    shards = [shard_store.Shard(str(i), n, 1) for i, n in enumerate([10] * 3 + [3000] * 4 + [50_000] * 9)]
    assert [[x.bytes for x in run] for run in s.due(shards)] == [[3000] * 4]


# --- nearest neighbours -----------------------------------------------------------------------------


def plain_nearest(rows, top):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            best = sorted(((-float(np.dot(v, w)), i) for i, w in usable if i != q))[:top]
            out[q] = [(i, -s) for s, i in best]
    return out


def run_nearest(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, id int, node int")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_nearest_small_and_unusable(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.integers(-8, 9, 4)]) for i in range(45)]
    rows += [(60, None), (80, [0.0] * 4), (100, [1.0, None, 0.0, 0.0]), (120, [float("nan"), 1.0, 1.0, 1.0]), (140, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (160, [])]
    rows += [(200 + i, [3.0, 1.0, -2.0, 5.0]) for i in range(60)] + [rows[0]]  # copies, ties, and a row twice
    want, got = plain_nearest(dict(rows).items(), 20), run_nearest(spark, rows)
    assert got.keys() == want.keys()
    for q, own in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in own] and np.allclose([s for _, s in got[q]], [s for _, s in own])
    few = run_nearest(spark, rows[:6])
    assert few.keys() == {0} and len(few[0]) == 5
    assert run_nearest(spark, rows[:1]) == {} and run_nearest(spark, []) == {}


def test_recall(spark):
    rng = np.random.default_rng(13)
    m = rng.standard_normal((3000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(m / np.linalg.norm(m, axis=1)[:, None])]
    want, got = plain_nearest(rows, 20), run_nearest(spark, rows)
    assert np.mean([len({i for i, _ in own} & {i for i, _ in got[q]}) / 20 for q, own in want.items()]) >= 0.9


def test_a_node_with_many_offers(spark):
    """Rows for one node are shrunk as they come, and the best neighbours stay."""
    nodes = spark.createDataFrame([(0, bytearray(b"\x01"), 1.0, [5], [0.5]), (1, bytearray(b"\x01"), 1.0, [], [])], "node long, code binary, scale float, ids array<long>, scores array<float>")
    offers = spark.range(10, 20_010).selectExpr("CAST(0 AS long) AS node", "array(id) AS ids", "array(CAST(id / 100000 AS float)) AS scores")
    got = {r["node"]: r for r in ann._merge(nodes, offers, 3).collect()}
    assert got[0]["ids"] == [5, 20_009, 20_008] and got[0]["fresh"] == [False, True, True] and got[1]["ids"] == []


def test_leaves_are_held_in_blocks(spark):
    """One leaf for all, far larger than a block: the graph still reaches good neighbours."""
    rng = np.random.default_rng(14)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)).astype(np.float32))]
    frame = spark.createDataFrame(rows, "id long, vec array<float>")
    graph = ann.build_graph(frame, k=10, leaf_rows=32, trees=2, rounds=6)
    assert graph.count() == 600 and graph.where(F.size("ids") < 10).count() == 0
    m = np.array([v for _, v in rows])
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    near = {r["node"]: set(r["ids"]) for r in graph.collect()}
    assert np.mean([len(near[i] & set(np.argsort(-s[i])[:10].tolist())) / 10 for i in range(600)]) > 0.8
