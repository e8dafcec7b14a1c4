"""Views of the driver's tables as observations, claims and evidence, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import modulo, seeded

JITTER_MS = 3000
SEED = 9238


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of five planes."""
    at = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("long")
    df = table(spark, sf_dir, "events").select(
        F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("event_id"),
        F.concat(F.lit("src-"), F.col("event_id").cast("string")).alias("source_id"),
        F.col("event_type").alias("source_type"),
        F.concat(F.lit("svc-"), F.lpad((F.col("user_id") % 50).cast("string"), 4, "0")).alias("service"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("source_ms"),
        F.when(k % 10 != 0, F.concat(F.lit("corr-"), F.lpad(k.cast("string"), 4, "0"), F.lit("-"), F.date_format(at, "yyyyMMdd"))).alias("correlation_id"),
    )
    payload = F.sha2(F.concat_ws("|", "source_id", "service", F.col("source_ms").cast("string"), F.coalesce("correlation_id", F.lit(""))), 256)
    return df.withColumns({"payload_hash": payload, "arrival_ms": F.col("source_ms") + modulo(seeded(F.lit(SEED), "arrival", F.col("event_id")), JITTER_MS + 1)})


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, with every tenth event seen again under a later id and every twentieth with another payload."""
    df = obs(spark, sf_dir)
    n = F.substring("event_id", 5, 9).cast("long")
    again = df.where(n % 10 == 3).withColumn("event_id", F.concat("event_id", F.lit("-duplicate-exact")))
    other = df.where(n % 20 == 7).withColumns({"event_id": F.concat("event_id", F.lit("-duplicate-conflict")), "payload_hash": F.sha2(F.concat("payload_hash", F.lit("|injected-conflict")), 256)})
    return df.unionByName(again).unionByName(other)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as deliveries: one identity may come with several payloads."""
    line = table(spark, sf_dir, "lineitem")
    body = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return line.select(
        F.col("l_orderkey").alias("source_id"),
        F.col("l_linenumber").cast("long").alias("sequence"),
        F.sha2(body, 256).alias("fingerprint"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("received"),
        F.concat_ws("-", F.lit("tenant"), (F.col("l_suppkey") % 3).cast("string")).alias("tenant_id"),
    )


def _fold(digest: str, n: int) -> str:
    words = ", ".join(f"('0x' || substr({digest}, {8 * i + 1}, 8))::BIGINT" for i in range(8))
    return f"list_reduce([0::BIGINT, {words}], lambda a, x: (a * 4294967296 + x) % {n})"


OBS = f"""
obs0 AS (
  SELECT 'evt-' || lpad(event_id::VARCHAR, 9, '0') AS event_id, 'src-' || event_id AS source_id, event_type AS source_type,
    'svc-' || lpad((user_id % 50)::VARCHAR, 4, '0') AS service, epoch_us(ts) // 1000 AS source_ms,
    CASE WHEN (props->>'$.k')::BIGINT % 10 <> 0 THEN 'corr-' || lpad(props->>'$.k', 4, '0') || '-' || strftime(ts, '%Y%m%d') END AS correlation_id
  FROM events),
obs AS (
  SELECT *, sha256(source_id || '|' || service || '|' || source_ms || '|' || coalesce(correlation_id, '')) AS payload_hash,
    source_ms + {_fold(f"sha256('{SEED}' || chr(31) || 'arrival' || chr(31) || event_id)", JITTER_MS + 1)} AS arrival_ms
  FROM obs0)"""

REPLAYS = (
    OBS
    + """,
replays AS (
  SELECT event_id, source_id, source_type, service, source_ms, correlation_id, payload_hash, arrival_ms FROM obs
  UNION ALL SELECT event_id || '-duplicate-exact', source_id, source_type, service, source_ms, correlation_id, payload_hash, arrival_ms
    FROM obs WHERE substr(event_id, 5, 9)::BIGINT % 10 = 3
  UNION ALL SELECT event_id || '-duplicate-conflict', source_id, source_type, service, source_ms, correlation_id, sha256(payload_hash || '|injected-conflict'), arrival_ms
    FROM obs WHERE substr(event_id, 5, 9)::BIGINT % 20 = 7),
prepared AS (
  SELECT *, event_id <> min(event_id) OVER (PARTITION BY source_type, source_id, payload_hash) AS replayed,
    min(payload_hash) OVER (PARTITION BY source_type, source_id) <> max(payload_hash) OVER (PARTITION BY source_type, source_id) AS conflict
  FROM replays),
retained AS (SELECT * FROM prepared WHERE NOT replayed)"""
)

CLAIMS = """
claims AS (
  SELECT l_orderkey AS source_id, l_linenumber::BIGINT AS sequence,
    sha256(l_partkey || '|' || l_suppkey || '|' || l_quantity::BIGINT || '|' || strftime(l_shipdate, '%Y-%m-%d')) AS fingerprint,
    strftime(l_shipdate, '%Y-%m-%d') AS received, 'tenant-' || (l_suppkey % 3) AS tenant_id
  FROM lineitem)"""
