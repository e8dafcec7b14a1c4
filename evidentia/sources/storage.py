"""Scratch tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault("base", tempfile.mkdtemp(prefix="evidentia-"))
    return f"{base.rstrip('/')}/evidentia/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: Column) -> DataFrame:
    """df dealt over all cores, by the columns if given: few bytes may be much work, and a small file is one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def nth(df: DataFrame, order: list[str], n: int) -> Row | None:
    """The n-th smallest row by these columns, or None if there are fewer.

    Rows are dealt into ranges; only the counts of the ranges reach the
    driver, and only the one range that holds the row is numbered.
    """
    if n < 1:
        return None
    rows = stored(df.select(*order).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = 0
    for r in sorted(rows.groupBy("__range").count().collect(), key=lambda r: r["__range"]):
        if before + r["count"] >= n:
            number = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
            return rows.where(F.col("__range") == r["__range"]).withColumn("__n", number).where(F.col("__n") == n - before).select(*order).first()
        before += r["count"]
    return None


def numbered(df: DataFrame, by: list[str], order: list[str], into: str) -> DataFrame:
    """df with each row's place from 0 among those equal in by, in this order.

    Rows are dealt into ranges, so a group of any size spreads over tasks:
    places within a range are added to the sizes of the ranges before it.
    """
    rows = stored(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n")).select(*by, "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*by, "__range"]]
    out = rows.withColumn("__r", within).alias("x").join(sizes.alias("y"), same)
    return out.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("__before") + F.col("__r") - 1).alias(into))
