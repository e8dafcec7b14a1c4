"""Three reconstruction policies: strict composite key, identifier only, anchored time.

Each takes observations and gives one row for each retained one:
(by.., event_id, group_id, candidate_id, flagged, abstained). candidate_id is
the group before a policy withholds it; flagged says its members contradict
each other. No policy reads truth columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.synthetic import OFFSETS_MS, PLANES
from .observe import prepared

SPAN_MS = OFFSETS_MS[-1] - OFFSETS_MS[0]
WINDOW_MS = 1500


def cadence(planes: tuple[str, ...] = PLANES, offsets: tuple[int, ...] = OFFSETS_MS) -> Column:
    """The chain start that an event's plane implies."""
    table = F.create_map(*[F.lit(x) for p, o in zip(planes, offsets, strict=True) for x in (p, o)])
    return F.col("source_ms") - F.element_at(table, F.col("source_type"))


def ambiguous(df: DataFrame, keys: list[str], span_ms: int, start: Column | None) -> DataFrame:
    """Flags of candidate groups: a plane twice, a span too long, or starts that disagree."""
    agg = [F.count("*").alias("n"), F.count_distinct("source_type").alias("planes"), (F.max("source_ms") - F.min("source_ms")).alias("span")]
    agg.append((F.min(start) != F.max(start) if start is not None else F.lit(False)).alias("starts"))
    return df.groupBy(*keys).agg(*agg).select(*keys, ((F.col("n") != F.col("planes")) | (F.col("span") > span_ms) | F.col("starts")).alias("flagged"))


def strict(df: DataFrame, by: tuple[str, ...] = (), span_ms: int = SPAN_MS, start: Column | None = None) -> DataFrame:
    """Groups by service and identifier; conflicting, unidentified and contradicting events stay alone, abstained."""
    rows = prepared(df, by).where(~F.col("replayed"))
    usable = ~F.col("conflict") & F.col("correlation_id").isNotNull()
    key = [*by, "service", "correlation_id"]
    flags = ambiguous(rows.where(usable), key, span_ms, start)
    out = rows.join(flags, key, "left").withColumn("usable", usable)
    taken = F.col("usable") & ~F.col("flagged")
    whole = F.concat(F.lit("strict:"), F.col("service"), F.lit(":"), F.col("correlation_id"))
    alone = F.when(F.col("conflict"), "strict:source-conflict:").when(F.col("correlation_id").isNull(), "strict:missing-id:").otherwise("strict:ambiguous:")
    return out.select(*by, "event_id", F.when(taken, whole).otherwise(F.concat(alone, F.col("event_id"))).alias("group_id"), F.when(F.col("usable"), whole).alias("candidate_id"), F.coalesce(F.col("usable") & F.col("flagged"), F.lit(False)).alias("flagged"), F.coalesce(~taken, F.lit(True)).alias("abstained"))


def identifier_only(df: DataFrame, by: tuple[str, ...] = (), span_ms: int = SPAN_MS, start: Column | None = None) -> DataFrame:
    """Groups by identifier alone; contradictions are flagged, not withheld."""
    rows = prepared(df, by).where(~F.col("replayed"))
    flags = ambiguous(rows.where(F.col("correlation_id").isNotNull()), [*by, "correlation_id"], span_ms, start)
    out = rows.join(flags, [*by, "correlation_id"], "left")
    whole = F.concat(F.lit("correlation-only:"), F.col("correlation_id"))
    return out.select(*by, "event_id", F.coalesce(whole, F.concat(F.lit("correlation-only:unjoined:"), F.col("event_id"))).alias("group_id"), whole.alias("candidate_id"), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.col("correlation_id").isNull().alias("abstained"))


def episodes(df: DataFrame, keys: list[str], window_ms: int = WINDOW_MS) -> DataFrame:
    """df with episode: groups of a key's events within window_ms of the episode's first, which never moves.

    A gap longer than the window always begins an episode, so a key's events
    first fall into islands between such gaps; only an island is folded.
    """
    order = Window.partitionBy(*keys).orderBy("source_ms", "event_id")
    rows = df.withColumn("__new", (F.col("source_ms") - F.lag("source_ms").over(order) > window_ms).cast("int"))
    rows = rows.withColumn("__island", F.sum(F.coalesce("__new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    times = F.array_sort(F.collect_set("source_ms"))
    anchors = F.aggregate(times, F.array().cast("array<long>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) > window_ms), F.array_append(acc, t)).otherwise(acc))
    folded = rows.groupBy(*keys, "__island").agg(anchors.alias("__anchors"))
    number = Window.partitionBy(*keys).orderBy("__island").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("__before", F.coalesce(F.sum(F.size("__anchors")).over(number), F.lit(0)))
    rows = rows.join(folded, [*keys, "__island"])
    at = F.size(F.filter("__anchors", lambda a: a <= F.col("source_ms"))) - 1
    return rows.withColumn("episode", (F.col("__before") + at).cast("long")).drop("__new", "__island", "__anchors", "__before")


def temporal(df: DataFrame, by: tuple[str, ...] = (), window_ms: int = WINDOW_MS, span_ms: int = SPAN_MS, start: Column | None = None) -> DataFrame:
    """Groups each service's events by anchored time windows, without identifiers and without abstaining."""
    rows = episodes(prepared(df, by).where(~F.col("replayed")), [*by, "service"], window_ms)
    key = [*by, "service", "episode"]
    out = rows.join(ambiguous(rows, key, span_ms, start), key)
    name = F.concat(F.lit("temporal:"), F.col("service"), F.lit(":"), F.format_string("%06d", F.col("episode")))
    return out.select(*by, "event_id", name.alias("group_id"), name.alias("candidate_id"), "flagged", F.lit(False).alias("abstained"))


POLICIES = {
    "strict_service_plus_correlation": strict,
    "correlation_id_only_ablation": identifier_only,
    "naive_temporal_window": temporal,
}
