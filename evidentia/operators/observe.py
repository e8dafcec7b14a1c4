"""Replay suppression and source conflicts, from operational columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("source_type", "source_id")


def prepared(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """df with replayed (a smaller event_id has the same source and payload) and conflict (the source has another payload).

    Both come from two aggregates and two joins on the source key, so a hot
    source is pre-aggregated, and its rows can be split.
    """
    exact = [*by, *KEY, "payload_hash"]
    first = df.groupBy(*exact).agg(F.min("event_id").alias("__first"))
    source = first.groupBy(*by, *KEY).agg((F.count("*") > 1).alias("conflict"))
    out = df.join(first, exact).join(source, [*by, *KEY])
    return out.withColumn("replayed", F.col("event_id") != F.col("__first")).drop("__first")


def conflicts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Source keys with more than one payload."""
    return df.groupBy(*by, *KEY).agg(F.count_distinct("payload_hash").alias("payloads"), F.count("*").alias("observations")).where("payloads > 1")
