"""Deterministic generators of source tables and of observations with known chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fraction, seeded

#: Planes in order, and the delay of each within a chain.
PLANES = ("deployment", "identity", "policy", "telemetry", "incident", "recovery")
OFFSETS_MS = (0, 250, 500, 750, 1000, 1250)
DELAY_MS = 25
SEEDS = tuple(9137 + 101 * trial for trial in range(1, 31))
OVERLAP = 0.25


def observations(spark: SparkSession, chains: int = 600, services: int = 24, seeds: tuple[int, ...] = SEEDS, overlap: float = OVERLAP) -> DataFrame:
    """Six-plane chains of each seed; of the paired chains of a service some overlap in time."""
    seed = spark.createDataFrame([(s,) for s in seeds], "seed long")
    plane = spark.createDataFrame([(i, p, o) for i, (p, o) in enumerate(zip(PLANES, OFFSETS_MS, strict=True))], "plane int, source_type string, offset_ms long")
    df = spark.range(chains).withColumnRenamed("id", "chain").crossJoin(F.broadcast(plane)).crossJoin(F.broadcast(seed))
    service = F.col("chain") % services
    turn = F.floor(F.col("chain") / services)
    cycle = F.floor(turn / 2)
    near = fraction(seeded(F.col("seed"), "schedule-overlap", service, cycle)) < overlap
    start = cycle * 20_000 + F.when(turn % 2 == 0, 0).when(near, 800).otherwise(10_000) + service * 3
    number = F.format_string("%06d-%06d", F.col("seed"), F.col("chain"))
    df = df.select(
        "seed",
        F.concat(F.lit("event-"), number, F.lit("-"), F.col("plane")).alias("event_id"),
        F.concat(F.col("source_type"), F.lit("-"), number).alias("source_id"),
        F.concat(F.lit("truth-"), number).alias("truth_chain_id"),
        (start + F.col("offset_ms")).cast("long").alias("source_ms"),
        F.format_string("svc-%04d", service).alias("service"),
        "source_type",
        F.concat(F.lit("corr-"), number).alias("correlation_id"),
    )
    payload = F.sha2(F.concat_ws("|", "source_id", "service", "source_ms", "correlation_id", F.lit("synthetic")), 256)
    return df.select("*", payload.alias("payload_hash"), F.col("source_ms").alias("truth_source_ms"), F.col("event_id").alias("canonical_event_id"), F.lit("canonical").alias("observation_kind"), (F.col("source_ms") + DELAY_MS).alias("arrival_ms"))


#: Columns of the six source tables by role.
ROLES = {
    "deployment": ("event_time", "principal", "app", "pipeline", "change_type", "status", "record_uri", "correlation", "release_integrity"),
    "identity": ("ts", "subject", "resource_service", "entitlement", "operation", "decision", "log_ref", "request_id", "least_privilege"),
    "policy": ("observed_at", "caller", "workload", "rule_id", "verb", "result", "evidence_url", "trace_key", "policy_conformance"),
    "telemetry": ("alert_time", "reporter", "target", "objective", "signal", "state", "query_ref", "incident_key", "service_availability"),
    "incident": ("changed_at", "responder", "affected_service", "objective", "action", "status", "ticket_ref", "incident_id", "incident_response"),
    "recovery": ("completed_at", "operator", "system", "recovery_target", "procedure", "outcome", "artifact_ref", "ticket_id", "recoverability"),
}
ROLE_NAMES = ("source_ts", "actor", "service", "policy", "action", "outcome", "source_pointer", "correlation_id")


#: What each plane's generated records say: actor (name, how many), policy (name, how many or none),
#: action, outcome when rare and otherwise, whether the rare case is a failure or a denial, and the record's locator.
SAID = {
    "deployment": ("pipeline-bot", 7, "release", 12, "rollout", "failed", "succeeded", "failure", "ci://runs"),
    "identity": ("operator", 17, "role", 9, "role_binding_review", "denied", "allowed", "denial", "iam://events"),
    "policy": ("admission", 3, "policy", 15, "evaluate", "deny", "pass", "denial", "policy://decisions"),
    "telemetry": ("monitor", 5, "availability-99.9", None, "health_transition", "degraded", "healthy", "failure", "otel://queries"),
    "incident": ("oncall", 11, "restore_service", None, "open_or_update", "investigating", "closed-no-impact", "failure", "ticket://incidents"),
    "recovery": ("recovery-bot", 4, "rto-60m", None, "verify_or_rollback", "rolled-back", "verified", "failure", "backup://checks"),
}


def planes(spark: SparkSession, n: int, services: int, seed: int) -> DataFrame:
    """n events of the six planes, six to a chain, still in one frame with the roles' own names."""
    chain, plane = F.expr("id div 6"), (F.col("id") % 6).cast("int")
    rare = {"failure": (chain + seed) % 23 == 0, "denial": (chain + seed) % 31 == 0}
    ms = F.lit(1_767_225_600_000) + F.col("id") * 250
    at = F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))

    def by_plane(value) -> Column:
        return F.element_at(F.array(*[value(SAID[p]) for p in PLANES]), plane + 1)

    def among(name: str, many: int | None) -> Column:
        return F.lit(name) if many is None else F.concat(F.lit(f"{name}-"), (chain % many).cast("string"))

    return spark.range(n).select(
        F.element_at(F.array(*map(F.lit, PLANES)), plane + 1).alias("source_type"),
        (F.col("id") + 1).alias("source_id"),
        at.alias("source_ts"),
        by_plane(lambda s: among(s[0], s[1])).alias("actor"),
        F.format_string("svc-%04d", (chain * 161 + seed) % services).alias("service"),
        by_plane(lambda s: among(s[2], s[3])).alias("policy"),
        by_plane(lambda s: F.lit(s[4])).alias("action"),
        by_plane(lambda s: F.when(rare[s[7]], s[5]).otherwise(s[6])).alias("outcome"),
        F.concat(by_plane(lambda s: F.lit(f"{s[8]}/")), (F.col("id") + 1).cast("string")).alias("source_pointer"),
        F.concat(F.lit(f"corr-{seed:04d}-"), F.lpad(chain.cast("string"), 8, "0")).alias("correlation_id"),
    )


def fragmented(df: DataFrame) -> dict[str, DataFrame]:
    """Six frames, one a plane, each with the column names of its own source."""
    out = {}
    for plane, names in ROLES.items():
        cols = [F.col(role).alias(name) for role, name in zip(ROLE_NAMES, names, strict=False)]
        out[plane] = df.where(F.col("source_type") == plane).select("source_id", *cols)
    return out
