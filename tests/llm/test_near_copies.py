"""Near copies by shingle similarity against brute force over all pairs."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from test_corpus_operators import DOCS, docs

from beaconframe.llm import near_copies


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_groups(texts, ids, limit=0.8):
    sets, group = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if group[i] != group[j] and shared >= limit * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                group = [group[j] if g == group[i] else g for g in group]
    low = {}
    for g, i in zip(group, ids, strict=True):
        low[g] = min(i, low.get(g, i))
    return [low[g] for g in group]


def edited():
    rng = np.random.default_rng(17)
    base = [[f"w{k}" for k in rng.integers(0, 300, 150)] for _ in range(6)]
    base += [base[0][:40] + [f"v{k}" for k in rng.integers(0, 300, 110)] for _ in range(3)]
    texts = [None, "", " \n", "x", "X", "a b c d", "A b c  d", "big " * 30_000]
    for i in range(150):
        words = list(base[i % 9])
        for at in rng.integers(0, 150, rng.integers(0, 6)):
            words[at] = f"new{rng.integers(0, 9)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("bucket", "popular"), [(64, 16), (2, 2)])
def test_all_pairs_of_the_limit_are_linked(spark, bucket, popular):
    texts = edited()
    got = near_copies.near_copies(docs(spark, list(enumerate(texts))), max_bucket=bucket, popular=popular, one_in=2)
    assert sorted(tuple(r) for r in got.collect()) == list(enumerate(plain_groups(texts, range(len(texts)))))


def test_stage_drops_copies_that_differ_in_many_bits(spark):
    texts = edited()
    rows = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, rows, "").collect())
    assert kept == sorted(set(plain_groups(texts, range(len(texts)))))
    assert near_copies.near_copies(docs(spark, [])).count() == 0


def test_one_row_of_each_group(spark):
    same, other = "the same words in both of them", "quite other words that nothing else has"
    rows = [(1, same), (7, same), (7, other), (None, "gone " * 9), (None, "gone " * 9), (9, "twice"), (9, "twice"), (None, same), (3, "A b"), (3, "a B")]
    frame = spark.createDataFrame([(i, t, "en", "s", k, 2, 3, 4) for k, (i, t) in enumerate(rows)], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame, "").collect()]
    pair = [t for i, t in kept if i == 3]
    assert len(pair) == 1 and pair[0] in ("A b", "a B")
    assert sorted((x for x in kept if x[0] != 3), key=str) == sorted([(1, same), (7, other), (None, "gone " * 9), (9, "twice")], key=str)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shared, x, y = (rng.integers(0, 1 << 63, n, np.uint64) for n in rng.integers(1, 3000, 3))
        a, b = np.unique(np.concatenate([shared, x])), np.unique(np.concatenate([shared, y]))
        apart = len(np.setxor1d(a, b))
        assert near_copies._differ(near_copies._parity(a), near_copies._parity(b)) <= apart
    assert near_copies._differ(near_copies._parity(a), near_copies._parity(a)) == 0


def test_simhash_links_come_first(spark, monkeypatch):
    """What deletion variants reach is linked by them alone; the exact join gets the pairs of different classes only."""
    seen, left, long = [], [], [f"w{k}" for k in np.random.default_rng(23).integers(0, 300, 400)]
    texts = edited() + [" ".join([*long[:at], f"one{at}", *long[at + 1 :]]) for at in range(0, 400, 16)]
    near, parity = near_copies.near_fingerprints, near_copies._by_parity

    def spied(nodes, max_bits):
        pairs = near(nodes, max_bits)
        fps = {r["node"]: r["fp"] for r in nodes.select("node", "fp").collect()}
        seen.append((fps, max_bits, [tuple(r) for r in pairs.collect()]))
        return pairs

    def asked(pairs, nodes, classes, similarity):
        out = parity(pairs, nodes, classes, similarity)
        root = {r["of"]: r["root"] for r in classes.collect()}
        left.append((root, [tuple(r) for r in out.collect()]))
        return out

    monkeypatch.setattr(near_copies, "near_fingerprints", spied)
    monkeypatch.setattr(near_copies, "_by_parity", asked)
    rows = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, rows, "").collect())
    assert kept == sorted(set(plain_groups(texts, range(len(texts)))))

    [(fps, max_bits, pairs)] = seen
    group = {n: n for n in fps}
    for a, b in pairs:
        group = {n: group[b] if g == group[a] else g for n, g in group.items()}
    close = [(x, y) for x in fps for y in fps if x < y and ((fps[x] ^ fps[y]) & (2**64 - 1)).bit_count() <= max_bits]
    assert len(close) > 10 and all(group[x] == group[y] for x, y in close) and len(pairs) < len(fps)
    assert left and any(root for root, _ in left)
    assert all(root.get(a, a) != root.get(b, b) for root, pairs in left for a, b in pairs)


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_only_rows_in_doubt_are_shuffled(spark, bits):
    """Rows to leave out are found without a shuffle of all texts; a bit row that is too small loses nothing."""
    rng = np.random.default_rng(31)
    texts = [rng.bytes(20_000).hex() for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(8)] + [(None, None), (2000, ""), (2000, "")]
    frame = docs(spark, rows)
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000), store.executorSummary("driver").totalShuffleWrite())[1]
    before, limit = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_copies.keep_one_each(frame, sieve_bits=bits).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [*enumerate(texts), (2000, "")]
    if bits > 64:
        assert written() - before < 3_000_000 < sum(map(len, texts))


def test_parity_bits_within_a_group():
    """The same verdict for many rows at once, of one and of different lengths; no pair of the limit goes."""
    rng = np.random.default_rng(41)
    sets = []
    for n in (1, 40, 500, 600, 2100):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(n) > share], rng.integers(0, 1 << 63, 1 + n // 20, np.uint64)])) for share in (0, 0.05, 0.1, 0.3) for _ in range(3)]
    parity, sizes = [near_copies._parity(s) for s in sets], np.array([len(s) for s in sets])
    near, listed, kept = near_copies._near_parity(parity, sizes, 0.8), 0, 0
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, len(sets))
        got = set(near(i, others).tolist())
        assert got == {j for j in others.tolist() if near_copies._differ(parity[i], parity[j]) <= (sizes[i] + sizes[j]) / 9 + 1e-9}
        shared = {j: len(np.intersect1d(sets[i], sets[j])) for j in others.tolist()}
        assert got >= {j for j, n in shared.items() if n >= 0.8 * (sizes[i] + sizes[j] - n)}
        listed, kept = listed + len(others), kept + len(got)
    assert 0 < kept < listed / 4


def test_group_of_a_common_passage(spark):
    """A popular shingle whose texts are mostly no copies: the pairs of the limit are linked, the others not."""
    rng = np.random.default_rng(43)
    passage, texts = [f"p{k}" for k in range(90)], []
    for i in range(60):
        words = list(passage)
        for at in rng.integers(0, 90, rng.integers(0, 7)):
            words[at] = f"new{rng.integers(0, 50)}"
        texts.append(" ".join(words + [f"own{i}x{k}" for k in range(rng.integers(0, 14))]))
    got = near_copies.near_copies(docs(spark, list(enumerate(texts))), max_bucket=4, popular=2, one_in=1)
    want = plain_groups(texts, range(len(texts)))
    assert sorted(tuple(r) for r in got.collect()) == list(enumerate(want)) and 5 < len(set(want)) < 55
