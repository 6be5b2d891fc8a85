"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy graph search.

*Graph.*  Vectors are quantized to a byte a component for everything but the final scores.
Random hyperplanes deal them to leaves of about ``leaf_rows``, ``trees`` times; the best in
the same leaf are each node's first neighbours.  Then NN-descent: every node gathers its
neighbours and the nodes that it is a neighbour of (two joins), and compares them with each
other; a pair goes on only if it improves the worst neighbour of one of the two, so that
few pairs leave a group.  Rounds end when few neighbours change.

*Search.*  Each query keeps the ``beam`` best nodes found.  In each hop the nodes not yet
expanded meet their row of the adjacency table (bucketed by node, so that it isn't shuffled
again), which holds the neighbours' codes: all are scored there, and only those that beat
the query's worst kept node come back.  It ends when no query has a node to expand.  The
best ``rescore`` are scored again in double precision on the original vectors.

Scale: equal vectors are one node, so copies cost nothing in the graph; in- and out-degrees
are bounded in the graph (and by the exact comparison of what the search keeps, not in the
result).  Nothing is collected but counts, and each round is written to the shared folder.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, column, materialize, scratch_path

_NODE = "node long, code binary, scale float"


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows with an id and a finite vector that isn't zero, of the most common length."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def _floats(col: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _codes(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int8).reshape(len(col), -1).astype(np.float32)


def _quantize(nodes: DataFrame) -> DataFrame:
    """(node, code, scale): a signed byte for each component, and what one step stands for."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if batch.num_rows:
                v = _floats(column(batch, "vec")).astype(np.float64)
                scale = np.abs(v).max(axis=1) / 127
                code = np.rint(v / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale.astype(np.float32))], names=["node", "code", "scale"])

    return nodes.select("id", "vec").mapInArrow(rows, _NODE)


def _groups(parts: Iterator[pa.RecordBatch], key: str, shrink: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows of each value of a sorted ``key``, also where a batch ends inside them.

    ``shrink`` makes few rows of many that say the same; it is applied whenever ``most``
    rows of one value are held, so that a value with any number of rows fits.
    """
    held: list[pa.RecordBatch] = []
    for batch in parts:
        if not batch.num_rows:
            continue
        keys = column(batch, key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and column(held[0], key)[0].as_py() != keys[a]:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            if shrink is not None and sum(x.num_rows for x in held) > most:
                held = [shrink(_joined(held))]
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lists(flat: np.ndarray, lengths: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


_LINKS = "node long, ids array<long>, scores array<float>"


def _first_links(nodes: DataFrame, n: int, dim: int, k: int, leaf_rows: int, trees: int, seed: int) -> DataFrame:
    """(node, ids, scores): for each tree, the best of the node's leaf; and of leaves dealt at random, so that nodes alone in their leaves have links too."""
    bits = max(0, math.ceil(math.log2(max(1, n) / leaf_rows)))
    random_leaves = max(1, n // leaf_rows)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((trees, bits, dim)).astype(np.float32)
        for batch in parts:
            if not batch.num_rows:
                continue
            codes = _codes(column(batch, "code"))
            for tree in range(trees):
                side = codes @ planes[tree].T > 0 if bits else np.zeros((len(codes), 0), bool)
                leaf = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(codes), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * (trees + 1) + tree), *(column(batch, c) for c in ("node", "code", "scale"))], names=["leaf", "node", "code", "scale"])
            if bits:
                mixed = column(batch, "node").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                leaf = (mixed % np.uint64(random_leaves)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * (trees + 1) + trees), *(column(batch, c) for c in ("node", "code", "scale"))], names=["leaf", "node", "code", "scale"])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in _blocks(parts, 2 * leaf_rows):
            ids, codes = column(leaf, "node").to_numpy(), _codes(column(leaf, "code"))
            codes = codes * column(leaf, "scale").to_numpy()[:, None]
            top = min(k, len(ids) - 1)
            if top < 1:
                continue
            for at in range(0, len(ids), 256):
                s = codes[at : at + 256] @ codes.T
                s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
                best = np.argpartition(-s, top - 1, axis=1)[:, :top]
                kept = np.take_along_axis(s, best, 1)
                lengths = [top] * len(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256]), _lists(ids[best].ravel(), lengths), _lists(kept.ravel(), lengths)], names=["node", "ids", "scores"])

    def _blocks(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        """A leaf, or a large one in blocks of ``most`` rows, so that no leaf is held whole."""
        held: list[pa.RecordBatch] = []
        for batch in parts:
            keys = column(batch, "leaf").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and column(held[0], "leaf")[0].as_py() != keys[a]:
                    yield _joined(held)
                    held = []
                while a < b:
                    room = most - sum(x.num_rows for x in held)
                    held.append(batch.slice(a, min(b - a, room)))
                    a += held[-1].num_rows
                    if sum(x.num_rows for x in held) >= most:
                        yield _joined(held)
                        held = []
        if held:
            yield _joined(held)

    dealt = nodes.mapInArrow(deal, f"leaf long, {_NODE}")
    return dealt.repartition("leaf").sortWithinPartitions("leaf", F.xxhash64("node")).mapInArrow(compare, _LINKS)


_GRAPH = f"{_NODE}, ids array<long>, scores array<float>, fresh array<boolean>"


def _merge(nodes: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The graph with what was found: of old and new neighbours the best ``k``, new ones marked fresh.

    ``nodes`` has one row for each node, with or without neighbours; ``found`` has any
    number of rows (node, ids, scores).
    """

    def shrink(group: pa.RecordBatch) -> pa.RecordBatch:
        """The node's own rows, which come first, and the best k of all others as one row."""
        own = int(column(group, "code").is_valid().to_numpy(zero_copy_only=False).sum())
        ids, scores = (column(group.slice(own), c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
        ids, first = np.unique(ids, return_index=True)
        best = np.argsort(-scores[first], kind="stable")[:k]
        rest = group.slice(own, 1).set_column(group.schema.get_field_index("ids"), group.schema.field("ids"), _lists(ids[best], [len(best)]).cast(group.schema.field("ids").type))
        rest = rest.set_column(group.schema.get_field_index("scores"), group.schema.field("scores"), _lists(scores[first][best], [len(best)]).cast(group.schema.field("scores").type))
        return _joined([group.slice(0, own), rest])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(parts, "node", shrink):
            own = column(group, "code").is_valid().to_numpy(zero_copy_only=False)
            if not own.any():
                continue
            at = int(np.flatnonzero(own)[0])
            ids, scores = (column(group, c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
            old = column(group, "ids")[at].as_py() or []
            # Equal pairs have equal scores, whichever way they were found.
            ids, first = np.unique(ids, return_index=True)
            scores = scores[first]
            best = np.argsort(-scores, kind="stable")[:k]
            ids = ids[best]
            out.append((column(group, "node")[at].as_py(), column(group, "code")[at].as_py(), column(group, "scale")[at].as_py(), ids, scores[best], ~np.isin(ids, np.array(old, np.int64))))
            if len(out) == 1024:
                yield _graph_batch(out)
                out = []
        if out:
            yield _graph_batch(out)

    found = found.select("node", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scale"), "ids", "scores")
    both = nodes.select("node", "code", "scale", "ids", "scores").union(found)
    return both.repartition("node").sortWithinPartitions("node", F.col("code").isNull()).mapInArrow(rows, _GRAPH)


def _graph_batch(out: list[tuple]) -> pa.RecordBatch:
    node, code, scale, ids, scores, fresh = zip(*out, strict=True)
    lengths = [len(x) for x in ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.array(code, pa.binary()), pa.array(scale, pa.float32()), _lists(np.concatenate(ids).astype(np.int64), lengths), _lists(np.concatenate(scores).astype(np.float32), lengths), _lists(np.concatenate(fresh).astype(bool), lengths)],
        names=["node", "code", "scale", "ids", "scores", "fresh"],
    )


def _gathered(graph: DataFrame, most: int, k: int) -> DataFrame:
    """(hub, node, code, scale, worst, fresh), rows of a hub together: its neighbours, and up to ``most`` nodes that it is a neighbour of."""
    # A node with room takes any neighbour.
    worst = F.when(F.size("ids") >= k, F.array_min("scores")).otherwise(F.lit(float("-inf")).cast("float"))
    links = graph.select("node", F.posexplode("ids").alias("at", "other"), "fresh").select("node", "other", F.col("fresh")[F.col("at")].alias("fresh"))
    own = graph.select(F.col("node").alias("own"), "code", "scale", worst.alias("worst"))
    there = links.join(own, F.col("other") == F.col("own")).select(F.col("node").alias("hub"), F.col("other").alias("node"), "code", "scale", "worst", "fresh", F.lit(True).alias("out"))
    back = graph.select(F.posexplode("ids").alias("at", "hub"), "node", "code", "scale", worst.alias("worst"), "fresh").select("hub", "node", "code", "scale", "worst", F.col("fresh")[F.col("at")].alias("fresh"), F.lit(False).alias("out"))
    # Out-links are few and all stay; of in-links the fresh ones come first, else in the order of a hash.
    rank = F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("out"), F.desc("fresh"), F.xxhash64("node", "hub")))
    return there.union(back).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank", "out")


def _descend(graph: DataFrame, most: int, k: int) -> DataFrame:
    """What a round finds: for each node, better neighbours among those that share a hub with it."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list = []
        ids: list = []
        scores: list = []
        for hub in _groups(parts, "hub"):
            fresh = column(hub, "fresh").to_numpy(zero_copy_only=False)
            if hub.num_rows < 2 or not fresh.any():
                continue
            own = column(hub, "node").to_numpy()
            codes = _codes(column(hub, "code")) * column(hub, "scale").to_numpy()[:, None]
            s = codes @ codes.T
            better = (s > column(hub, "worst").to_numpy()[:, None]) & (fresh[:, None] | fresh) & (own[:, None] != own)
            for a in np.flatnonzero(better.any(axis=1)).tolist():
                b = np.flatnonzero(better[a])
                nodes.append(own[a])
                ids.append(own[b])
                scores.append(s[a, b])
            if len(nodes) > 4096:
                yield _links_batch(nodes, ids, scores)
                nodes, ids, scores = [], [], []
        if nodes:
            yield _links_batch(nodes, ids, scores)

    return _gathered(graph, most, k).mapInArrow(compare, _LINKS)


def _links_batch(nodes: list, ids: list, scores: list) -> pa.RecordBatch:
    lengths = [len(x) for x in ids]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(np.concatenate(ids), lengths), _lists(np.concatenate(scores).astype(np.float32), lengths)], names=["node", "ids", "scores"])


def build_graph(vectors: DataFrame, *, k: int = 24, leaf_rows: int = 2048, trees: int = 4, rounds: int = 4, settled: float = 0.02, seed: int = 7) -> DataFrame:
    """The neighbour graph of (id, vec): one row for each vector, with its ``k`` best neighbours."""
    nodes = materialize(_quantize(vectors), "ann-codes")
    n, size = nodes.agg(F.count(F.lit(1)), F.max(F.length("code"))).first()
    bare = nodes.withColumn("ids", F.expr("CAST(array() AS array<long>)")).withColumn("scores", F.expr("CAST(array() AS array<float>)"))
    graph = materialize(_merge(bare, _first_links(nodes, n, size or 1, k, leaf_rows, trees, seed), k), "ann-graph")
    for _ in range(rounds):
        graph = materialize(_merge(graph, _descend(graph, 2 * k, k), k), "ann-graph")
        changed, links = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("ids"))).first()
        if not links or changed <= settled * links:
            break
    return graph


_ADJACENT = "node long, ids array<long>, codes binary, scales array<float>"


def build_adjacency(graph: DataFrame, *, degree: int = 40, bucket_bytes: int = 8 << 20) -> tuple[DataFrame, str]:
    """(node, ids, codes, scales), links in both directions with the codes, bucketed by node; and the table's name."""
    spark = graph.sparkSession

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hub in _groups(parts, "hub"):
            ids, first = np.unique(column(hub, "node").to_numpy(), return_index=True)
            code, scale = column(hub, "code").to_pylist(), column(hub, "scale").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [column(hub, "hub").slice(0, 1), _lists(ids, [len(ids)]), pa.array([b"".join(code[i] for i in first)], pa.binary()), _lists(scale[first], [len(ids)])], names=["node", "ids", "codes", "scales"]
            )

    n, size = graph.agg(F.count(F.lit(1)), F.max(F.length("code"))).first()
    buckets = max(8, math.ceil(n * degree * ((size or 0) + 12) / bucket_bytes))
    name = f"ann_{uuid.uuid4().hex}"
    table = _gathered(graph, degree, 1).mapInArrow(rows, _ADJACENT).repartition(buckets, "node")
    table.write.bucketBy(buckets, "node").sortBy("node").option("path", scratch_path(spark, "ann-adjacent")).saveAsTable(name)
    return spark.table(name), name


_BEAM = "query long, code binary, scale float, ids array<long>, scores array<float>, open array<boolean>"


def search_graph(queries: DataFrame, adjacency: DataFrame, *, beam: int = 256, hops: int = 40) -> DataFrame:
    """(query, ids, scores, is_over): the ``beam`` best nodes found for each of ``queries`` (query, code, scale, ids, scores).

    ``ids`` and ``scores`` are the nodes from which a query sets out.  is_over is false for
    queries that still have nodes to expand after ``hops`` hops.
    """
    state = materialize(queries.withColumn("open", F.transform("ids", lambda _: F.lit(True))), "ann-beam")

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 2048):
            out_q, out_i, out_s = [], [], []
            queries_, worst = column(batch, "query").to_numpy(), column(batch, "worst").to_numpy()
            own = _codes(column(batch, "code")) * column(batch, "scale").to_numpy()[:, None] if batch.num_rows else None
            ids, scales = column(batch, "ids"), column(batch, "scales")
            flat_ids, flat_scales = ids.flatten().to_numpy(), scales.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())])
            for i, codes in enumerate(column(batch, "codes")):
                a, b = ends[i], ends[i + 1]
                s = (np.frombuffer(codes.as_buffer(), np.int8).reshape(b - a, -1).astype(np.float32) @ own[i]) * flat_scales[a:b]
                keep = np.flatnonzero(s > worst[i])
                if len(keep):
                    out_q.append(queries_[i])
                    out_i.append(flat_ids[a:b][keep])
                    out_s.append(s[keep])
            if out_q:
                yield _links_batch(out_q, out_i, out_s)

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(parts, "query"):
            ids, scores = (column(group, c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
            at = int(np.flatnonzero(column(group, "code").is_valid().to_numpy(zero_copy_only=False))[0])
            known = np.array(column(group, "ids")[at].as_py(), np.int64)
            ids, first = np.unique(ids, return_index=True)
            best = np.argsort(-scores[first], kind="stable")[:beam]
            ids, scores = ids[best], scores[first][best]
            # All that was kept before has been expanded by now.
            fresh = ~np.isin(ids, known)
            n = [len(ids)]
            yield pa.RecordBatch.from_arrays([column(group, c).slice(at, 1) for c in ("query", "code", "scale")] + [_lists(ids, n), _lists(scores.astype(np.float32), n), _lists(fresh, n)], names=["query", "code", "scale", "ids", "scores", "open"])

    for _ in range(hops):
        worst = F.when(F.size("ids") >= beam, F.array_min("scores")).otherwise(F.lit(float("-inf")).cast("float"))
        todo = state.select("query", "code", "scale", worst.alias("worst"), F.posexplode("open").alias("at", "is_open"), F.col("ids").alias("held")).where("is_open").select("query", "code", "scale", "worst", F.col("held")[F.col("at")].alias("at_node"))
        met = todo.join(adjacency, F.col("at_node") == F.col("node")).select("query", "code", "scale", "worst", "ids", "codes", "scales")
        found = met.mapInArrow(score, "node long, ids array<long>, scores array<float>")
        found = found.select(F.col("node").alias("query"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scale"), "ids", "scores")
        both = state.select("query", "code", "scale", "ids", "scores").union(found)
        state = materialize(both.repartition("query").sortWithinPartitions("query", F.col("code").isNull()).mapInArrow(merge, _BEAM), "ann-beam")
        if not state.where(F.exists("open", lambda x: x)).limit(1).count():
            break
    return state.select("query", "ids", "scores", (~F.exists("open", lambda x: x)).alias("is_over"))


def _compare_all(short: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(query, other): for each node of ``short`` (query), the best ``most`` of each block of ``nodes`` (id, vec), ties and the node included."""

    def packed(id_name: str, matrix: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(parts, size):
                if batch.num_rows:
                    m = _floats(column(batch, "vec")).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([_lists(column(batch, "id").to_numpy(), [len(m)]), pa.array([m.tobytes()], pa.binary())], names=[id_name, matrix])

        return rows

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 1):
            q, n = (column(batch, c).flatten().to_numpy() for c in ("queries", "others"))
            a, b = (np.frombuffer(column(batch, c)[0].as_py()).reshape(len(x), -1) for c, x in (("qm", q), ("om", n)))
            s = a @ b.T
            top = min(most, len(n))
            limit = np.partition(s, len(n) - top, axis=1)[:, len(n) - top]
            # Sums in another order differ in the last places; the final scores decide.
            slack = 1e-9 * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
            x, y = np.nonzero(s >= (limit - slack)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q[x]), pa.array(n[y])], names=["query", "other"])

    asked = nodes.join(short, F.col("id") == F.col("query"), "left_semi").select("id", "vec")
    asked = asked.mapInArrow(packed("queries", "qm", 256), "queries array<long>, qm binary")
    return asked.crossJoin(nodes.select("id", "vec").mapInArrow(packed("others", "om", 2048), "others array<long>, om binary")).mapInArrow(multiply, "query long, other long")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    top: int = 20,
    k: int = 24,
    degree: int = 40,
    beam: int | None = None,
    hops: int = 40,
    rescore: int = 64,
    rounds: int = 4,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, id, score): the ``top`` nearest found to each row of ``vectors`` where ``is_query`` holds.

    Nearest is the largest inner product in double precision; ties go to the smaller id, and
    a row is not its own neighbour.  All usable rows are indexed.  Queries for which the
    search finds fewer than ``top`` candidates, though there are more, are compared with all,
    and so are those whose search isn't over after ``hops`` hops.  ``beam`` is by default 16
    times the binary logarithm of the number of distinct vectors, and 256 at least.

    Rows with a null id, and vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do those whose length is not the most common one.  Rows
    that repeat an id and vector count once.  Copies of a vector under other ids are all
    candidates.  An empty table, or one vector alone, gives no rows.
    """
    rows = usable(vectors.withColumn(id_col, F.col(id_col).cast("long")), id_col, vec_col)
    marks = vectors.where(is_query).select(F.col(id_col).cast("long").alias("query_id")).where("query_id IS NOT NULL").distinct()
    # Two hashes of 64 bits tell vectors apart; -0.0 hashes as 0.0.
    plain = F.transform("vec", lambda x: x + F.lit(0.0).cast(rows.schema["vec"].dataType.elementType))
    hashed = materialize(rows.select("id", F.xxhash64(plain).alias("h"), F.xxhash64(F.reverse(plain), F.lit(1)).alias("g")).distinct(), "ann-hashes")
    firsts = hashed.groupBy("h", "g").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    members = materialize(hashed.join(firsts, ["h", "g"]).select("id", "node", "n"), "ann-members")
    heads = members.where("id = node").select(F.col("id").alias("head")).distinct()
    nodes = materialize(rows.join(heads, F.col("id") == F.col("head"), "left_semi").dropDuplicates(["id"]), "ann-nodes")

    graph = build_graph(nodes, k=k, rounds=rounds, seed=seed)
    beam = beam or max(256, 16 * graph.count().bit_length())
    asked = members.join(marks, F.col("id") == F.col("query_id")).select("query_id", "node").distinct()
    asked = materialize(asked, "ann-queries")
    # Equal queries are searched once, from their own place in the graph.
    starts = graph.join(asked.select(F.col("node").alias("asked")).distinct(), F.col("node") == F.col("asked"), "left_semi")
    own_score = F.lit(float("inf")).cast("float")
    starts = starts.select(F.col("node").alias("query"), "code", "scale", F.concat(F.array("node"), "ids").alias("ids"), F.concat(F.array(own_score), "scores").alias("scores"))
    adjacency, name = build_adjacency(graph, degree=degree)
    try:
        found = search_graph(starts, adjacency, beam=beam, hops=hops)
    finally:
        vectors.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # its files go with the session

    close = found.select("query", F.explode(F.slice(F.reverse(F.array_sort(F.arrays_zip(F.col("scores"), F.col("ids")))), 1, rescore)).alias("x")).select("query", F.col("x.ids").alias("other"))
    a, b = nodes.select(F.col("id").alias("a"), F.col("vec").alias("va")), nodes.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    # No query can use more than the first top + 1 ids of a vector.
    first_ids = members.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("nth") <= top + 1)
    first_ids = first_ids.select(F.col("node").alias("of"), F.col("id").alias("candidate"))
    in_query = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")

    def scores(close: DataFrame) -> DataFrame:
        scored = close.join(a, F.col("query") == F.col("a")).join(b, F.col("other") == F.col("b")).select("query", "other", inner_product(F.col("va"), F.col("vb")).alias("score"))
        scored = materialize(scored, "ann-scores")
        listed = scored.join(first_ids, F.col("other") == F.col("of")).select("query", "candidate", "score")
        return materialize(listed.withColumn("nth", F.row_number().over(in_query)).where(F.col("nth") <= top + 1), "ann-listed")

    listed = scores(close)
    enough = min(top, members.select("id").distinct().count() - 1)
    had = asked.join(listed, F.col("node") == F.col("query")).where("candidate != query_id").groupBy(F.col("query_id").alias("had_id")).count()
    short = asked.join(had, F.col("query_id") == F.col("had_id"), "left").where(F.coalesce("count", F.lit(0)) < enough).select(F.col("node").alias("query"))
    short = short.union(found.where("NOT is_over").select("query")).distinct()
    short = materialize(short, "ann-short")
    if short.limit(1).count():
        # The node itself is among the best, and top + 1 ids are listed.
        whole = scores(_compare_all(short, nodes, top + 1).distinct())
        listed = listed.join(short, "query", "left_anti").select("query", "candidate", "score").union(whole.select("query", "candidate", "score"))
    answered = asked.join(listed, F.col("node") == F.col("query")).where("candidate != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate"))
    return answered.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("candidate").alias(id_col), "score")
