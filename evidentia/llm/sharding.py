"""Sharding by size-tiered compaction (operator 3), in DataFrame functions only.

A table is a folder of immutable Parquet shards and of manifests. A manifest
lists the live shards of one version. append() writes arrivals as small shards
and commits a new version; compact() sorts the live shards into tiers of
similar size (each tier FACTOR times the one before), rewrites every tier
with at least FACTOR shards into files near the target size, and commits the
version in which the new files replace the old; what merged may fill the next
tier, so it repeats until no tier has FACTOR shards. Readers of an older
version keep their files.

Every attempt writes to a folder of its own and commits just what it wrote
there, so neither a job that died nor another writer can stand in its way or
slip files into it. A commit creates the next manifest under a name that must
not exist: of two writers one fails and starts anew, and what a lost job left
is named by no manifest. Merging reads whole shards of a tier and joins scan partitions
without a shuffle; rows keep their bytes.

Defined results: rows, nulls, ties and repeated rows are kept as they are;
empty arrivals commit a version without new shards; a table without shards
reads as empty with its schema; all columns of the arrivals are kept.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 64 << 10
FACTOR = 4
ARRIVAL_ROWS = 2000


@dataclass(frozen=True)
class Shard:
    """A live file, by a path below the table's folder."""

    path: str
    bytes: int
    run: int

    @property
    def tier(self) -> int:
        tier, limit = 0, SMALLEST_BYTES
        while self.bytes > limit:
            tier, limit = tier + 1, limit * FACTOR
        return tier


class ShardedTable:
    """A versioned table of shards below root."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> None:
        self.spark, self.root, self.target_bytes = spark, root.rstrip("/"), target_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self._path(f"{self.root}/manifests/{version:010d}.json")

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        top = self._path(f"{self.root}/manifests")
        if not self._fs.exists(top):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(top)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, shards} of a version, the last by default."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        found = self.spark.read.text(self._manifest(version).toString(), wholetext=True).first()[0]
        got = json.loads(found)
        return got | {"shards": [Shard(**s) for s in got["shards"]]}

    def _commit(self, version: int, schema: str, shards: list[Shard]) -> int:
        """Makes the version visible, or raises if another writer was first."""
        body = json.dumps({"version": version, "schema": json.loads(schema), "shards": [vars(s) for s in sorted(shards, key=lambda s: s.path)]})
        hidden = self._path(f"{self.root}/manifests/.{version:010d}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(hidden, True)
        out.write(bytearray(body.encode()))
        out.close()
        target = self._manifest(version)
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(hidden, target, options)  # fails if the version exists
        return version

    def _written(self, folder: str, run: int) -> list[Shard]:
        files = self._fs.listStatus(self._path(f"{self.root}/{folder}"))
        return [Shard(f"{folder}/{f.getPath().getName()}", f.getLen(), run) for f in files if f.getPath().getName().startswith("part-")]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Writes df as small shards of at most so many rows each and commits them."""
        now = self.manifest()
        version = now["version"] + 1
        folder = f"data/arrived-{version:010d}-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/{folder}")
        return self._commit(version, df.schema.json(), now["shards"] + self._written(folder, version))

    def compact(self) -> int:
        """Merges tiers with FACTOR shards or more until there are none; returns the version, a new one only if something merged."""
        version = self.version()
        while (now := self._merge()) != version:
            version = now
        return version

    def _merge(self) -> int:
        """One pass over the tiers as they are; returns the version, a new one only if something merged."""
        now = self.manifest()
        version = now["version"] + 1
        tiers: dict[int, list[Shard]] = {}
        for s in now["shards"]:
            if s.bytes < self.target_bytes // 2:
                tiers.setdefault(s.tier, []).append(s)
        live = set(now["shards"])
        for tier, old in sorted(tiers.items()):
            if len(old) < FACTOR:
                continue
            files = max(1, round(sum(s.bytes for s in old) / self.target_bytes))
            folder = f"data/merged-{version:010d}-{tier:02d}-{uuid.uuid4().hex}"
            schema = T.StructType.fromJson(now["schema"])
            self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in old]).coalesce(files).write.parquet(f"{self.root}/{folder}")
            live = (live - set(old)) | set(self._written(folder, version))
        if live == set(now["shards"]):
            return now["version"]
        return self._commit(version, json.dumps(now["schema"]), list(live))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        got = self.manifest(version)
        if not got["schema"]:
            raise ValueError(f"{self.root} has no version yet")
        schema = T.StructType.fromJson(got["schema"])
        if not got["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in got["shards"]])
