"""Line de-duplication against a sharded minimal perfect hash.

One pass hashes the lines of all documents to 128 bits and counts, for each distinct line,
in how many documents it is and which of them is the largest (with map-side combine, so a
line that all documents share costs one row a task).  The lines that are in more than one
document are the keys of a minimal perfect hash: a shard is a cascade of bit arrays, and a
key's slot is the rank of its bit.  Slots index compact arrays of fingerprints, counts and
keepers.  A second pass over the documents probes the arrays, and the count decides; there
is no join of lines.  A line that one document alone holds meets no fingerprint.

Scale: shards hold about ``keys_per_shard`` lines and are built independently.  Up to
``broadcast_bytes`` of arrays (the sum of their sizes is known before) go to all workers,
and documents are probed where they are read.  Beyond that, line hashes are dealt to the
shards, with copies of a hot shard for salted probes, and only the numbers of dropped lines
come back to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, column, materialize

_SPACE = b" \t\n\x0b\x0c\r"
_NO_LINES = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))
SHARD_SCHEMA = "shard long, levels array<int>, bits binary, fingerprints binary, counts binary, keepers binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a lower-cased line: without white space at its ends; None if it is too short."""
    key = line.strip(_SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return key


def line_hashes(text: str | None, min_chars: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of lines, high and low half of the hash and line number of each line with a key)."""
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    found = [(i, xxhash.xxh3_128_digest(k)) for i, x in enumerate(lines) if len(x) >= min_chars and (k := line_key(x, min_chars)) is not None]
    if not found:
        return len(lines), *_NO_LINES
    halves = np.frombuffer(b"".join(h for _, h in found), ">u8").reshape(-1, 2).astype(np.uint64)
    return len(lines), halves[:, 0], halves[:, 1], np.array([i for i, _ in found])


# --- the minimal perfect hash of one shard -------------------------------------------------


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit number for each level, by multiplying and shifting."""
    x = (x ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys, at about 4 bits a key.

    Each level has twice as many bits as keys are left.  Keys that are alone on a bit set it
    and are done; the others go on to the next level.  A key's slot is the number of bits set
    before its own.
    """

    def __init__(self, levels: list[int], bits: bytes) -> None:
        self.levels = levels
        self.words = np.frombuffer(bits, np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.offsets = np.cumsum([0, *levels])[:-1]

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[list[int], bytes]:
        left, levels, parts, level = np.unique(keys), [], [], 0
        while len(left):
            size = -(-max(64, 2 * len(left)) // 64) * 64
            at = _mix(left, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little"))
            levels.append(size)
            left, level = left[~alone[at.astype(np.int64)]], level + 1
        return levels, b"".join(p.tobytes() for p in parts)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where a foreign key meets no set bit.  Other foreign keys get some slot."""
        slots = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.offsets[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            slots[left[hit]] = self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            left = left[~hit]
        return slots


class Shard:
    """The arrays of one shard: probing gives in how many documents a line is, 0 if it isn't indexed, and its keeper."""

    def __init__(self, levels: list[int], bits: bytes, fingerprints: bytes, counts: bytes, keepers: bytes) -> None:
        self.hash = PerfectHash(levels, bits)
        self.fingerprints, self.counts, self.keepers = np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, np.int32), np.frombuffer(keepers, np.int64)

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = self.hash.slots(high)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == low[known]
        counts, keepers = np.zeros(len(high), np.int32), np.zeros(len(high), np.int64)
        counts[known], keepers[known] = self.counts[slots[known]], self.keepers[slots[known]]
        return counts, keepers


def _build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    high = rows["high"].to_numpy().view(np.uint64)
    # Two lines with the same high half (one in 2**64 pairs) can't both have a slot: the first in order stays indexed.
    order = np.lexsort((rows["low"].to_numpy(), high))
    order = order[np.append(True, high[order][1:] != high[order][:-1])]
    high = high[order]
    levels, bits = PerfectHash.build(high)
    slots = PerfectHash(levels, bits).slots(high)
    put = lambda name, kind: (out := np.empty(len(slots), kind), out.__setitem__(slots, rows[name].to_numpy()[order].astype(kind)))[0]
    arrays = [[key[0].as_py()], [levels], [bits], [put("low", np.int64).tobytes()], [np.minimum(put("n_docs", np.int64), np.iinfo(np.int32).max).astype(np.int32).tobytes()], [put("keeper", np.int64).tobytes()]]
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 4]
    return pa.table([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=["shard", "levels", "bits", "fingerprints", "counts", "keepers"])


# --- the operator ---------------------------------------------------------------------------


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(high, low, keeper): the distinct lines of each document with its id."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            high, low, ids, missing = [], [], [], []
            for doc, text in zip(column(batch, id_col).to_pylist(), column(batch, text_col).to_pylist(), strict=True):
                _, h, l, _ = line_hashes(text, min_chars)
                if len(h):
                    both = np.unique(np.stack([h, l]), axis=1)
                    high.append(both[0])
                    low.append(both[1])
                    ids.append(np.full(both.shape[1], 0 if doc is None else doc))
                    missing.append(np.full(both.shape[1], doc is None))
            if high:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).view(np.int64)) for x in (high, low)), pa.array(np.concatenate(ids), pa.int64(), mask=np.concatenate(missing))], names=["high", "low", "keeper"])

    return docs.select(id_col, text_col).mapInArrow(rows, "high long, low long, keeper long")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, keys_per_shard: int = 100_000) -> tuple[DataFrame, int]:
    """The shards of lines that are in more than one row of ``docs``, and how many there are."""
    found = (
        _lines(docs, id_col, text_col, min_chars).groupBy("high", "low")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("keeper").alias("keeper"))
        .where((F.col("n_docs") > 1) & F.col("keeper").isNotNull())
    )
    found = materialize(found, "lines")
    n_shards = max(1, -(-found.count() // keys_per_shard))
    shards = found.withColumn("shard", F.pmod("low", F.lit(n_shards))).groupBy("shard").applyInArrow(_build_shard, SHARD_SCHEMA)
    return materialize(shards, "line-shards"), n_shards


def _cut(text: str | None, drop: np.ndarray) -> tuple[str, int]:
    """The text without the lines that ``drop`` numbers."""
    if not len(drop):
        return text or "", 0
    gone = set(drop.tolist())
    return "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone), len(gone)


def drop_repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    keys_per_shard: int = 100_000,
    broadcast_bytes: int = 64 << 20,
    digest: bool = False,
) -> DataFrame:
    """``docs`` without repeated lines, or with ``digest`` (id, n_lines, n_dropped, kept_sha256).

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.
    Keys of at least ``min_chars`` code points that are in at least ``min_docs`` rows lose
    all their lines except in the rows with the largest id that holds them.

    Ids are whole numbers that fit a long.  A null or empty text is one empty line; a null stays null where the text is returned,
    and a text of which nothing is left becomes empty.  A row is a document, so rows that
    repeat an id count as several, and all rows with the largest id keep the line.  Null ids
    count, but are never the largest; lines that only rows without an id hold stay.  An
    empty table gives no rows.  Other columns pass through, whatever their names.
    """
    if min_docs < 2:
        raise ValueError("a line that one document holds is not repeated")
    spark = docs.sparkSession
    shards, n_shards = build_index(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, keys_per_shard=keys_per_shard)
    arrays = shards.select("shard", "levels", "bits", "fingerprints", "counts", "keepers")
    size = shards.agg(F.sum(F.length("bits") + F.length("fingerprints") + F.length("counts") + F.length("keepers"))).first()[0] or 0
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_sha256 string" if digest else docs.schema

    def out(batch: pa.RecordBatch, texts: list, drops: list[np.ndarray]) -> pa.RecordBatch:
        cut = [_cut(t, d) for t, d in zip(texts, drops, strict=True)]
        if digest:
            arrays = [
                column(batch, id_col), pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()), pa.array([n for _, n in cut], pa.int64()),
                pa.array([hashlib.sha256(k.encode("utf-8", "surrogatepass")).hexdigest() for k, _ in cut], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_lines", "n_dropped", "kept_sha256"])
        at = batch.schema.get_field_index(text_col)
        kept = pa.array([t if t is None else k for t, (k, _) in zip(texts, cut, strict=True)], batch.schema.field(at).type)
        return batch.set_column(at, batch.schema.field(at), kept)

    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([tuple(r) for r in arrays.collect()])

        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = {r[0]: Shard(r[1], *map(bytes, r[2:])) for r in sent.value}
            for batch in batches(parts):
                texts, drops = column(batch, text_col).to_pylist(), []
                for doc, text in zip(column(batch, id_col).to_pylist(), texts, strict=True):
                    _, high, low, at = line_hashes(text, min_chars)
                    drop = np.zeros(len(at), bool)
                    of = low.view(np.int64) % n_shards
                    for s in np.unique(of):
                        if s in index:
                            mine = of == s
                            n_docs, keeper = index[s].probe(high[mine], low[mine])
                            drop[mine] = (n_docs >= min_docs) & (keeper != doc if doc is not None else True)
                    drops.append(at[drop])
                yield out(batch, texts, drops)

        return (docs.select(id_col, text_col) if digest else docs).mapInArrow(rows, schema)
    return _probe_by_shard(docs, arrays, n_shards, id_col, text_col, min_chars, min_docs, digest, schema, out)


def _probe_by_shard(docs, arrays, n_shards, id_col, text_col, min_chars, min_docs, digest, schema, out) -> DataFrame:
    """The way beyond the broadcast: hashes go to the shards, and dropped line numbers come back."""
    salts = 16

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for doc, text in zip(column(batch, id_col).to_pylist(), column(batch, text_col).to_pylist(), strict=True):
                _, high, low, at = line_hashes(text, min_chars)
                if len(at):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(low.view(np.int64) % n_shards * salts + at % salts), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array([doc] * n, pa.int64()), pa.array(at, pa.int64()), pa.array([xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)] * n, pa.int64())],
                        names=["cell", "high", "low", "doc", "line", "sum"],
                    )

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come in order, each with its shard before its lines."""
        cell, index = None, None
        for batch in parts:
            cells = column(batch, "cell").to_numpy()
            for at in np.unique(cells):
                rows = batch.filter(pa.array(cells == at))
                if at != cell:
                    cell, index = at, None
                is_shard = column(rows, "levels").is_valid()
                for r in rows.filter(is_shard).to_pylist():
                    index = Shard(r["levels"], r["bits"], r["fingerprints"], r["counts"], r["keepers"])
                rows = rows.filter(column(rows, "levels").is_null())
                if index is None or not rows.num_rows:
                    continue
                n_docs, keeper = index.probe(column(rows, "high").to_numpy().view(np.uint64), column(rows, "low").to_numpy().view(np.uint64))
                ids = column(rows, "doc")
                other = (ids.fill_null(0).to_numpy() != keeper) | ids.is_null().to_numpy(zero_copy_only=False)
                hit = pa.array((n_docs >= min_docs) & other)
                yield pa.RecordBatch.from_arrays([column(rows, n).filter(hit) for n in ("doc", "sum", "line")], names=["doc", "sum", "line"])

    lines = docs.select(id_col, text_col).mapInArrow(hashes, "cell long, high long, low long, doc long, line long, sum long")
    copies = arrays.withColumn("cell", F.explode(F.sequence(F.col("shard") * salts, F.col("shard") * salts + salts - 1)))
    met = copies.unionByName(lines, allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell", F.col("levels").isNull())
    hits = met.mapInArrow(probe, "doc long, sum long, line long")
    # Equal rows (same id and text) drop the same lines.
    drops = hits.groupBy("doc", "sum").agg(F.collect_set("line").alias("lines"))
    drops = materialize(drops, "line-drops")

    def tagged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sums = [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in column(batch, text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.to_struct_array(), column(batch, id_col), pa.array(sums, pa.int64())], names=["row", "id", "text_sum"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            own = pa.RecordBatch.from_struct_array(column(batch, "row"))
            gone = [np.array(x or (), np.int64) for x in column(batch, "lines").to_pylist()]
            yield out(own, column(own, text_col).to_pylist(), gone)

    rows = docs.select(id_col, text_col) if digest else docs
    shape = T.StructType([T.StructField("row", rows.schema), T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_sum", T.LongType())])
    joined = rows.mapInArrow(tagged, shape).join(drops, F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_sum") == F.col("sum")), "left")
    return joined.select("row", "lines").mapInArrow(cut, schema)
