"""A store of immutable shards with size-tiered compaction, on Spark's own readers and writers.

Arrivals are appended as small Parquet files, the shards.  A manifest lists the live shards
of one version; readers see the shards of the newest manifest and nothing else, so files of
a job that was lost half-way are never seen.  A version is committed by renaming a finished
file to a name that must not exist, which is atomic, and makes a second writer fail instead
of overwriting.

Compaction puts shards into tiers by size (each ``growth`` times the one before) and merges
the shards of a tier when there are ``fan_in`` of them, so many into one, up to files of
about the target size.  A merge reads shards side by side and writes fewer files without a
shuffle, so a hot source or key makes no difference, and the runs of all tiers that are due
are merged at the same time.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class VersionConflict(RuntimeError):
    """Another writer has committed the version that this one was about to commit."""


class ShardStore:
    """A table under ``root``, a folder in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fan_in: int = 4, growth: int = 4, smallest: int = 1 << 20) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.growth, self.smallest = target_bytes, fan_in, growth, smallest
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files ---------------------------------------------------------------------------

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self, name: str) -> list[tuple[str, int]]:
        """(name under the root, bytes) of the data files in a folder."""
        if not self._fs.exists(self._path(name)):
            return []
        return sorted((f"{name}/{f.getPath().getName()}", f.getLen()) for f in self._fs.listStatus(self._path(name)) if f.getPath().getName().endswith((".parquet", ".json")))

    # --- versions ------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(name.rpartition("/v")[2].removesuffix(".json")) for name, _ in self._files("manifest")]

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards"}; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"manifest/v{version:012d}.json"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return found | {"shards": [Shard(**s) for s in found["shards"]]}

    def _commit(self, base: dict, schema: str, shards: list[Shard]) -> int:
        version = base["version"] + 1
        waiting, final = self._path(f"manifest/.{uuid.uuid4().hex}.tmp"), self._path(f"manifest/v{version:012d}.json")
        stream = self._fs.create(waiting, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        option = self._hadoop.Options.Rename
        options = self.spark._sc._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            context.rename(waiting, final, options)
        except Exception as error:
            self._fs.delete(waiting, False)
            if "FileAlreadyExists" in str(error) or self._fs.exists(final):
                raise VersionConflict(f"version {version} exists") from error
            raise
        return version

    # --- reading and writing ---------------------------------------------------------------

    def _scan(self, shards: list[Shard], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one if none is given."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("the store is empty")
        return self._scan(found["shards"], found["schema"])

    def _write(self, rows: DataFrame, max_rows: int = 0) -> list[Shard]:
        """New immutable shards, not yet part of any version, of up to ``max_rows`` rows (0: one a partition).  Files without rows are left out."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", max_rows).parquet(f"{self.root}/{name}")
        files = self._files(name)
        if not files:
            return []
        counts = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}").groupBy(F.col("_metadata.file_name").alias("file")).count().collect()
        n = {r["file"]: r["count"] for r in counts}
        return [Shard(path, size, n[path.rpartition("/")[2]]) for path, size in files if path.rpartition("/")[2] in n]

    def _schema(self, base: dict, rows: DataFrame) -> str:
        if base["schema"] is not None and [(f.name, f.dataType) for f in T.StructType.fromJson(json.loads(base["schema"]))] != [(f.name, f.dataType) for f in rows.schema]:
            raise ValueError("the arrival's columns differ from the store's")
        return base["schema"] or rows.schema.json()

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as small shards, one for each of its partitions, and return the new version.

        Columns may be of any name and hold nulls; rows may repeat.  All arrivals must have
        the columns of the first.  An arrival without rows makes a version without new
        shards.
        """
        base = self.manifest()
        return self._commit(base, self._schema(base, rows), [*base["shards"], *self._write(rows)])

    def ingest(self, rows: DataFrame, *, shard_rows: int, arrival_shards: int = 16) -> int:
        """Let ``rows`` arrive in groups of small shards, compacting whenever a tier is due, and return the last version.

        One pass over ``rows``, without a shuffle, writes all of them as shards of up to
        ``shard_rows`` rows.  Each group of ``arrival_shards`` is then committed as an
        arrival of its own, so the number of arrivals grows with the input, however many
        files or partitions it comes in.  Shards that were merged are deleted on the way.
        """
        base = self.manifest()
        schema, waiting = self._schema(base, rows), self._write(rows, shard_rows)
        groups = [waiting[k : k + arrival_shards] for k in range(0, len(waiting), arrival_shards)] or [[]]
        for at, group in enumerate(groups):
            base = self.manifest()
            self._commit(base, schema, [*base["shards"], *group])
            if self.due(self.manifest()["shards"]):
                self.compact()
                self.vacuum(spare={s.path for later in groups[at + 1 :] for s in later})
        return self.manifest()["version"]

    # --- compaction --------------------------------------------------------------------------

    def tier(self, size: int) -> int:
        """0 up to ``smallest`` bytes, and one more for each ``growth`` times that."""
        return max(0, math.ceil(math.log(max(1, size) / self.smallest, self.growth)))

    def due(self, shards: list[Shard], fan_in: int | None = None) -> list[list[Shard]]:
        """The runs to merge: the shards of each tier with ``fan_in`` of them, but for those near the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes < self.target_bytes:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= (fan_in or self.fan_in)]

    def _merge(self, run: list[Shard], schema: str) -> list[Shard]:
        """The rows of ``run`` in files of ``fan_in`` shards each, or of the target size if that is less."""
        total = sum(s.bytes for s in run)
        files = max(1, round(total / min(self.target_bytes, self.fan_in * total / len(run))))
        return self._write(self._scan(run, schema).coalesce(files))

    def compact(self) -> int:
        """Merge until no tier is due, and return the version.  Each round of merges is a version of its own."""
        while True:
            base = self.manifest()
            runs = self.due(base["shards"])
            if not runs:
                return base["version"]
            with ThreadPoolExecutor(len(runs)) as side_by_side:
                merged = list(side_by_side.map(lambda run: self._merge(run, base["schema"]), runs))
            gone = {s.path for run in runs for s in run}
            self._commit(base, base["schema"], [*(s for s in base["shards"] if s.path not in gone), *(s for new in merged for s in new)])

    def vacuum(self, keep: int = 1, spare: set[str] = frozenset()) -> int:
        """Delete the shards that none of the newest ``keep`` versions lists, nor ``spare``, and older manifests.

        Only for when no reader holds an older version and no writer is between write and
        commit.  Returns the number of deleted shards.
        """
        versions = sorted(self.versions())
        live = spare | {s.path for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifest/v{v:012d}.json"), False)
        dropped = 0
        if self._fs.exists(self._path("data")):
            for folder in self._fs.listStatus(self._path("data")):
                name = f"data/{folder.getPath().getName()}"
                files = [f for f, _ in self._files(name)]
                gone = [f for f in files if f not in live]
                dropped += len(gone)
                if len(gone) == len(files):
                    self._fs.delete(folder.getPath(), True)
                for f in gone if len(gone) < len(files) else []:
                    self._fs.delete(self._path(f), False)
        return dropped


def rows_per_shard(rows: DataFrame, shard_bytes: int) -> int:
    """How many rows make shards of about ``shard_bytes``, by the sizes of the scan's files and the rows in them."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in rows.inputFiles()]
    total = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return max(1, rows.count() * shard_bytes // max(1, total))
