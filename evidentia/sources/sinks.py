"""Writers: append-only tables, one folder a plane, canonical JSON lines, CSV and checksum manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.verify import inventory
from .readers import ContractError


class AppendOnly:
    """A Parquet table that only grows; rows are unique by key, checked before they are written."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def append(self, df: DataFrame) -> int:
        """Adds rows; raises if a key repeats among them or is there already. Gives the number of rows."""
        k = list(self.keys)
        counts = df.groupBy(*k).agg(F.count("*").alias("n"))
        again = counts.where("n > 1")
        if self.exists():
            again = again.unionByName(counts.join(self.read().select(*k), k, "left_semi"))
        if bad := again.limit(1).collect():
            raise ContractError(f"key is there already: {bad[0].asDict()}")
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(self.path)
        return seen.get["n"]

    def overwrite(self, df: DataFrame) -> None:
        raise ContractError("rows of this table are never replaced")

    delete = update = overwrite


def by_plane(df: DataFrame, path: str, column: str = "source_type") -> None:
    """One folder a plane, written in one pass."""
    df.write.partitionBy(column).parquet(path)


def json_lines(df: DataFrame, path: str, force: bool = False) -> None:
    """Canonical JSON lines (keys sorted, nulls kept); an existing path is refused unless forced."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.mode("overwrite" if force else "errorifexists").text(path)


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table is refused."""
    if df.isEmpty():
        raise ContractError("no rows to write")
    df.write.option("header", "true").csv(path)


def checksums(spark: SparkSession, folder: str, path: str) -> None:
    """A manifest of a folder's files: digest, two blanks, path below the folder; by path."""
    rows = inventory(spark, folder).orderBy("path")
    rows.select(F.concat_ws("  ", "digest", "path").alias("value")).coalesce(1).write.text(path)


def raw_json(df: DataFrame, path: str, raw: str = "raw") -> None:
    """Source records as they came, each with its digest, appended."""
    df.select(F.col(raw).alias("raw"), F.sha2(raw, 256).alias("digest")).write.mode("append").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """One row as one canonical JSON text in a folder that must not exist."""
    if df.limit(2).count() != 1:
        raise ContractError("a report is one row")
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def bundle(spark: SparkSession, parts: dict[str, DataFrame], path: str, check=None) -> None:
    """Tables below one folder that appears whole or not at all: written beside it, checked, listed in a manifest, then renamed.

    check gets the parts as they were read back and raises if they won't do.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ContractError(f"{path} is there already")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    try:
        for name, df in parts.items():
            df.write.parquet(f"{staged}/{name}")
        if check:
            check({name: spark.read.schema(df.schema).parquet(f"{staged}/{name}") for name, df in parts.items()})
        checksums(spark, staged, f"{staged}/manifest")
        if fs.exists(target) or not fs.rename(at, target):
            raise ContractError(f"{path} is there already")
    finally:
        if fs.exists(at):
            fs.delete(at, True)
