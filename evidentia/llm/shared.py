"""What the operators of this subpackage share: scratch tables and small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Blocks of 64 bits that a filter of keys has: 131,072 rows to broadcast at most, whatever the number of keys.
FILTER_BLOCKS = 1 << 17


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    may leave it unset; it then gets a temporary folder of this process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "base" not in _own:
            _own["base"] = tempfile.mkdtemp(prefix="evidentia-")
        base = _own["base"]
    return f"{base.rstrip('/')}/evidentia/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(spark: SparkSession, df: DataFrame, name: str, arrow_rows: int = 500) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again, which cuts the lineage; also gives the path.

    While it is written, Arrow batches hold few rows: texts and token sets are
    long, and a batch has no bound in bytes.
    """
    path, before = scratch(spark, name), spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, min(int(before), arrow_rows) if int(before) > 0 else arrow_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _bits(h: Column) -> Column:
    """Two bits of a block, by other bits of the hash than those that choose the block."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))
    return bit(40).bitwiseOR(bit(50))


def apart(df: DataFrame, on: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose hash surely isn't in keys (h), and all others: those that are and false hits.

    A blocked Bloom filter of fixed size tells them, so rows of the first kind,
    with their texts, need no exchange. An exact join must follow for the
    others; beyond what the filter holds only their share rises.
    """
    place = lambda h: F.pmod(h, F.lit(FILTER_BLOCKS))
    table = keys.select(place(F.col("h")).alias("__place"), _bits(F.col("h")).alias("__word")).groupBy("__place").agg(F.bit_or("__word").alias("__word"))
    asked = df.withColumn("__asked", on).join(F.broadcast(table), place(F.col("__asked")) == F.col("__place"), "left")
    hit = F.coalesce(F.col("__word").bitwiseAND(_bits(F.col("__asked"))) == _bits(F.col("__asked")), F.lit(False))
    return asked.where(~hit).select(*df.columns), asked.where(hit).select(*df.columns)


def whole_text(text: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """From now on the session's Arrow batches hold few rows, for programs whose texts are long."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
