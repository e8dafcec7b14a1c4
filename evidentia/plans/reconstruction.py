"""Queries of observation, reconstruction and their quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import faults, observe, reconstruct, score
from ..sources import synthetic
from ..sources.storage import stored
from ..sources.views import JITTER_MS, OBS, REPLAYS, obs, replays

DAY = 86_400_000
SPAN = DAY // 4
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {REPLAYS} SELECT event_id, replayed, conflict FROM prepared")
def replay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.prepared(replays(spark, sf_dir)).select("event_id", "replayed", "conflict")


@query(f"WITH {REPLAYS} SELECT source_type, source_id, count(DISTINCT payload_hash) AS payloads, count(*) AS observations FROM replays GROUP BY ALL HAVING count(DISTINCT payload_hash) > 1")
def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.conflicts(replays(spark, sf_dir))


STRICT = (
    REPLAYS
    + f""",
candidate AS (
  SELECT service, correlation_id, count(*) <> count(DISTINCT source_type) OR max(source_ms) - min(source_ms) > {SPAN} AS flagged
  FROM retained WHERE NOT conflict AND correlation_id IS NOT NULL GROUP BY ALL),
strict AS (
  SELECT event_id, service, source_type, source_ms, arrival_ms, r.correlation_id, NOT conflict AND r.correlation_id IS NOT NULL AS usable, coalesce(flagged, false) AND NOT conflict AS flag,
    CASE WHEN conflict THEN 'strict:source-conflict:' || event_id WHEN r.correlation_id IS NULL THEN 'strict:missing-id:' || event_id
      WHEN flagged THEN 'strict:ambiguous:' || event_id ELSE 'strict:' || service || ':' || r.correlation_id END AS group_id,
    conflict OR r.correlation_id IS NULL OR coalesce(flagged, false) AS abstained
  FROM retained r LEFT JOIN candidate c USING (service, correlation_id))"""
)


def _replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replays, stored: a policy reads its observations for the sources, the flags and the rows."""
    return stored(replays(spark, sf_dir), "observations")


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.strict(_replays(spark, sf_dir), span_ms=SPAN)


@query(f"WITH {STRICT} SELECT group_id, count(*) AS members, min(event_id) AS first_event, count(*) FILTER (abstained) AS abstained FROM strict GROUP BY group_id")
def strict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("members"), F.min("event_id").alias("first_event"), F.count_if("abstained").alias("abstained"))


@query(f"WITH {STRICT} SELECT event_id, group_id, CASE WHEN usable THEN 'strict:' || service || ':' || correlation_id END AS candidate_id, flag AS flagged, abstained FROM strict")
def strict_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir)


ID_ONLY = (
    REPLAYS
    + f""",
cand AS (SELECT correlation_id, count(*) <> count(DISTINCT source_type) OR max(source_ms) - min(source_ms) > {SPAN} AS flagged FROM retained WHERE correlation_id IS NOT NULL GROUP BY ALL),
id_only AS (
  SELECT event_id, coalesce('correlation-only:' || r.correlation_id, 'correlation-only:unjoined:' || event_id) AS group_id,
    'correlation-only:' || r.correlation_id AS candidate_id, coalesce(flagged, false) AS flagged, r.correlation_id IS NULL AS abstained
  FROM retained r LEFT JOIN cand USING (correlation_id))"""
)


@query(f"WITH {ID_ONLY} SELECT * FROM id_only")
def id_only_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.identifier_only(_replays(spark, sf_dir), span_ms=SPAN)


TEMPORAL = (
    REPLAYS
    + f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY source_ms, event_id) AS rn FROM retained),
walk AS (
  WITH RECURSIVE w AS (
    SELECT service, rn, event_id, source_ms AS anchor, 0::BIGINT AS episode FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.service, o.rn, o.event_id, CASE WHEN o.source_ms - w.anchor <= {DAY} THEN w.anchor ELSE o.source_ms END,
      CASE WHEN o.source_ms - w.anchor <= {DAY} THEN w.episode ELSE w.episode + 1 END
    FROM w JOIN ordered o ON o.service = w.service AND o.rn = w.rn + 1)
  SELECT * FROM w)"""
)


@query(f"WITH {TEMPORAL} SELECT event_id, service, episode FROM walk")
def temporal_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observe.prepared(replays(spark, sf_dir)).where("not replayed")
    return reconstruct.episodes(rows, ["service"], DAY).select("event_id", "service", "episode")


@query(
    f"""WITH {TEMPORAL}, eps AS (
  SELECT w.service, episode, count(*) <> count(DISTINCT source_type) OR max(source_ms) - min(source_ms) > {SPAN} AS flagged FROM walk w JOIN ordered o USING (service, rn) GROUP BY ALL)
SELECT w.event_id, 'temporal:' || service || ':' || lpad(episode::VARCHAR, 6, '0') AS group_id, 'temporal:' || service || ':' || lpad(episode::VARCHAR, 6, '0') AS candidate_id, flagged, false AS abstained
FROM walk w JOIN eps USING (service, episode)"""
)
def temporal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.temporal(_replays(spark, sf_dir), window_ms=DAY, span_ms=SPAN)


@query(f"WITH {REPLAYS} SELECT service, correlation_id, count(*) <> count(DISTINCT source_type) OR max(source_ms) - min(source_ms) > {SPAN} AS flagged FROM retained WHERE correlation_id IS NOT NULL GROUP BY ALL")
def ambiguity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observe.prepared(replays(spark, sf_dir)).where("not replayed and correlation_id is not null")
    return reconstruct.ambiguous(rows, ["service", "correlation_id"], SPAN, None)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier-only groups as predictions, service and identifier as truth; events without an identifier are alone in both."""
    rows = obs(spark, sf_dir)
    alone = F.concat(F.lit("alone:"), F.col("event_id"))
    return rows.select("event_id", F.coalesce("correlation_id", alone).alias("group_id"), F.coalesce(F.concat_ws(":", "service", F.when(F.col("correlation_id").isNotNull(), F.col("correlation_id"))), alone).alias("x"), "correlation_id", "service", "source_ms", "arrival_ms", alone.alias("alone")).withColumn("truth", F.when(F.col("correlation_id").isNull(), F.col("alone")).otherwise(F.concat("service", F.lit(":"), "correlation_id"))).drop("x", "alone")


BOTH = (
    OBS
    + """,
both_ AS (SELECT event_id, source_ms, arrival_ms, coalesce(correlation_id, 'alone:' || event_id) AS group_id,
  CASE WHEN correlation_id IS NULL THEN 'alone:' || event_id ELSE service || ':' || correlation_id END AS truth FROM obs)"""
)


@query(
    f"""WITH {BOTH},
p AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS predicted FROM (SELECT count(*) AS n FROM both_ GROUP BY group_id)),
t AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS wanted FROM (SELECT count(*) AS n FROM both_ GROUP BY truth)),
c AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS correct FROM (SELECT count(*) AS n FROM both_ GROUP BY group_id, truth))
SELECT predicted, wanted, correct, predicted - correct AS false_joins, wanted - correct AS missed,
  round(correct / nullif(predicted, 0)::DOUBLE, 9) AS precision_, round(correct / nullif(wanted, 0)::DOUBLE, 9) AS recall_ FROM p, t, c"""
)
def pair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one pass: counts of the finest groups add up to the two coarser ones
    fine = _both(spark, sf_dir).groupBy("group_id", "truth").agg(F.count("*").alias("n"))
    pairs = lambda n: F.sum(F.expr(f"{n} * ({n} - 1) div 2"))
    a = fine.groupBy("group_id").agg(F.sum("n").alias("m"), pairs("n").alias("c"))
    b = fine.groupBy("truth").agg(F.sum("n").alias("m"))
    out = a.agg(pairs("m").alias("predicted"), F.sum("c").alias("correct")).crossJoin(b.agg(pairs("m").alias("wanted")))
    return out.select("predicted", "wanted", "correct", (F.col("predicted") - F.col("correct")).alias("false_joins"), (F.col("wanted") - F.col("correct")).alias("missed"), F.round(F.try_divide("correct", "predicted"), 9).alias("precision_"), F.round(F.try_divide("correct", "wanted"), 9).alias("recall_"))


@query(
    f"""WITH {BOTH},
g AS (SELECT group_id, count(*) AS n, min(truth) AS truth, count(DISTINCT truth) AS truths FROM both_ GROUP BY group_id),
t AS (SELECT truth, count(*) AS n FROM both_ GROUP BY truth)
SELECT count(*) AS groups, count(*) FILTER (g.truths = 1 AND g.n = t.n) AS exact_groups, count(*) FILTER (g.truths > 1) AS mixed FROM g JOIN t USING (truth)"""
)
def exact_chain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _both(spark, sf_dir)
    g = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.min("truth").alias("truth"), F.count_distinct("truth").alias("truths"))
    t = rows.groupBy("truth").agg(F.count("*").alias("size"))
    return g.join(t, "truth").agg(F.count("*").alias("groups"), F.expr("count_if(truths = 1 and n = size)").alias("exact_groups"), F.expr("count_if(truths > 1)").alias("mixed"))


@query(
    f"""WITH {BOTH},
o AS (SELECT group_id, truth, count(*) AS n FROM both_ GROUP BY ALL),
s AS (SELECT group_id, sum(n) AS size FROM o GROUP BY ALL)
SELECT group_id, max(n) AS best, round(max(n) / any_value(size)::DOUBLE, 9) AS coverage FROM o JOIN s USING (group_id) GROUP BY group_id"""
)
def member_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _both(spark, sf_dir).groupBy("group_id", "truth").agg(F.count("*").alias("n"))
    out = o.groupBy("group_id").agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    return out.select("group_id", "best", F.round(F.col("best") / F.col("size"), 9).alias("coverage"))


@query(
    f"""WITH {BOTH},
f AS (SELECT group_id, max(source_ms) - min(source_ms) > {SPAN} AS flagged, count(DISTINCT truth) > 1 AS mixed FROM both_ GROUP BY group_id)
SELECT count(*) FILTER (flagged AND mixed) AS true_positive, count(*) FILTER (flagged AND NOT mixed) AS false_positive, count(*) FILTER (mixed AND NOT flagged) AS false_negative,
  round(count(*) FILTER (flagged AND mixed) / nullif(count(*) FILTER (flagged), 0)::DOUBLE, 9) AS precision_, round(count(*) FILTER (flagged AND mixed) / nullif(count(*) FILTER (mixed), 0)::DOUBLE, 9) AS recall_ FROM f"""
)
def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _both(spark, sf_dir).groupBy("group_id").agg((F.max("source_ms") - F.min("source_ms") > SPAN).alias("flagged"), (F.count_distinct("truth") > 1).alias("mixed"))
    out = f.agg(F.expr("count_if(flagged and mixed)").alias("true_positive"), F.expr("count_if(flagged and not mixed)").alias("false_positive"), F.expr("count_if(mixed and not flagged)").alias("false_negative"), F.count_if("flagged").alias("f"), F.count_if("mixed").alias("m"))
    return out.select("true_positive", "false_positive", "false_negative", F.round(F.try_divide("true_positive", "f"), 9).alias("precision_"), F.round(F.try_divide("true_positive", "m"), 9).alias("recall_"))


@query(
    f"""WITH {BOTH}, m AS (SELECT truth, max(arrival_ms) - min(source_ms) AS ms FROM both_ GROUP BY truth)
SELECT count(*) AS chains, quantile_cont(ms::DOUBLE, 0.5) AS p50_ms, quantile_cont(ms::DOUBLE, 0.95) AS p95_ms, max(ms) AS max_ms FROM m"""
)
def completion_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _both(spark, sf_dir).groupBy("truth").agg((F.max("arrival_ms") - F.min("source_ms")).alias("ms"))
    return m.agg(F.count("*").alias("chains"), F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"), F.max("ms").alias("max_ms"))


@query(
    f"""WITH {OBS} SELECT count(*) AS inversions FROM obs a JOIN obs b
ON (a.source_ms, a.event_id) < (b.source_ms, b.event_id) AND (a.arrival_ms, a.event_id) > (b.arrival_ms, b.event_id) AND b.source_ms <= a.source_ms + {JITTER_MS}"""
)
def arrival_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.arrival_inversions(obs(spark, sf_dir), (), JITTER_MS + 1, "source_ms").agg(F.coalesce(F.sum("inversions"), F.lit(0)).alias("inversions"))


@query(
    f"""WITH {OBS}, h AS (SELECT event_id, sha256('9238' || chr(31) || 'sample' || chr(31) || event_id) AS h FROM obs),
r AS (SELECT *, row_number() OVER (ORDER BY h, event_id) AS rank FROM h)
SELECT event_id, h AS digest FROM r WHERE rank <= (SELECT round_even(count(*) * 0.1, 0) FROM h)"""
)
def hash_sample_10pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).select("event_id", F.sha2(F.concat_ws("\x1f", F.lit("9238"), F.lit("sample"), "event_id"), 256).alias("digest"))
    # ranks in two steps: counts by the first two bytes, then ranks within those
    rows = rows.withColumn("b", F.substring("digest", 1, 4))
    sizes = rows.groupBy("b").agg(F.count("*").alias("n"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    sizes = sizes.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.bround(F.sum("n").over(total) * F.lit(0.1)).cast("long").alias("most"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("digest", "event_id"))
    return rows.join(F.broadcast(sizes), "b").withColumn("rank", F.col("start") + rank).where("rank <= most").select("event_id", "digest")


# --- faults, on observations with their identifiers as chains ----------------------------------------


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(obs(spark, sf_dir).where("correlation_id is not null"), "observations")
    more = {"seed": F.lit(9238).cast("long"), "truth_chain_id": F.concat_ws(":", "service", "correlation_id"), "truth_source_ms": F.col("source_ms"), "canonical_event_id": F.col("event_id"), "observation_kind": F.lit("canonical")}
    return df.withColumns(more)


CHAINED = OBS + ",\nchained AS (SELECT *, service || ':' || correlation_id AS truth_chain_id FROM obs WHERE correlation_id IS NOT NULL)"


def _picked(label: str, rate: float) -> str:
    return f"""(SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY sha256('9238' || chr(31) || '{label}' || chr(31) || event_id), event_id) AS r FROM chained)
      WHERE r <= (SELECT round_even(count(*) * {rate}, 0) FROM chained))"""


def _sha(*parts: str) -> str:
    return "sha256('9238' || chr(31) || " + " || chr(31) || ".join(parts) + ")"


@query(f"WITH {CHAINED}, hit AS {_picked('fault', 0.1)} SELECT event_id, CASE WHEN event_id NOT IN (SELECT event_id FROM hit) THEN correlation_id END AS correlation_id FROM chained")
def fault_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.missing_random(_chained(spark, sf_dir), 0.1, "fault").select("event_id", "correlation_id")


def _fold(digest: str, n: str) -> str:
    words = ", ".join(f"('0x' || substr({digest}, {8 * i + 1}, 8))::BIGINT" for i in range(8))
    return f"list_reduce([0::BIGINT, {words}], lambda a, x: (a * 4294967296 + x) % {n})"


CHAINS = CHAINED + ",\nchains AS (SELECT truth_chain_id, arg_min(service, (source_ms, event_id)) AS service, arg_min(correlation_id, (source_ms, event_id)) AS correlation_id FROM chained GROUP BY ALL)"


@query(
    f"""WITH {CHAINS}, hit AS {_picked('fault', 0.05)},
place AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY truth_chain_id) - 1 AS place, count(*) OVER (PARTITION BY service) AS many FROM chains),
i AS (SELECT c.event_id, c.service, place, {_fold(_sha("'fault'", "'donor'", "c.event_id"), "greatest(many - 1, 1)")} AS i
  FROM chained c JOIN hit USING (event_id) JOIN place p ON p.truth_chain_id = c.truth_chain_id),
given AS (SELECT event_id, d.correlation_id AS given FROM i LEFT JOIN place d ON d.service = i.service AND d.place = i.i + CASE WHEN i.i >= i.place THEN 1 ELSE 0 END)
SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM hit) THEN given ELSE correlation_id END AS correlation_id FROM chained LEFT JOIN given USING (event_id)"""
)
def fault_wrong_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.wrong_id(_chained(spark, sf_dir), 0.05, "fault").select("event_id", "correlation_id")


@query(
    f"""WITH {CHAINS},
r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY {_sha("'fault'", "service", "truth_chain_id")}, truth_chain_id) - 1 AS r FROM chains),
pairs AS (SELECT a.truth_chain_id AS donor, b.truth_chain_id AS victim, a.correlation_id AS given FROM r a JOIN r b ON a.service = b.service AND a.r % 2 = 0 AND b.r = a.r + 1),
hit AS (SELECT victim, given FROM (SELECT *, row_number() OVER (ORDER BY {_sha("'fault-pairs'", "donor || '::' || victim")}, donor || '::' || victim) AS k FROM pairs) WHERE k <= (SELECT round_even(count(*) * 0.05, 0) FROM chains))
SELECT event_id, coalesce(given, correlation_id) AS correlation_id FROM chained LEFT JOIN hit ON victim = truth_chain_id"""
)
def fault_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.collisions(_chained(spark, sf_dir), 0.05, "fault", True).select("event_id", "correlation_id")


CROSS = (
    CHAINS
    + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY {h}, truth_chain_id) AS r FROM chains),
walk AS (
  WITH RECURSIVE w AS (
    SELECT r, truth_chain_id, correlation_id, service AS held, 1::BIGINT AS waiting, 0::BIGINT AS run, 1::BIGINT AS pushed, 0::BIGINT AS popped, true AS pushes FROM ranked WHERE r = 1
    UNION ALL
    SELECT x.r, x.truth_chain_id, x.correlation_id, CASE WHEN w.waiting = 0 THEN x.service ELSE w.held END,
      CASE WHEN w.waiting > 0 AND x.service <> w.held THEN w.waiting - 1 ELSE w.waiting + 1 END, CASE WHEN w.waiting = 0 THEN w.run + 1 ELSE w.run END,
      CASE WHEN w.waiting = 0 THEN 1 WHEN x.service <> w.held THEN w.pushed ELSE w.pushed + 1 END, CASE WHEN w.waiting = 0 THEN 0 WHEN x.service <> w.held THEN w.popped + 1 ELSE w.popped END, w.waiting = 0 OR x.service = w.held
    FROM w JOIN ranked x ON x.r = w.r + 1)
  SELECT * FROM w),
pairs AS (SELECT a.truth_chain_id AS donor, b.truth_chain_id AS victim, a.correlation_id AS given FROM walk a JOIN walk b ON a.run = b.run AND a.pushes AND NOT b.pushes AND a.pushed = b.popped)"""
)


@query(
    f"""WITH {CROSS.format(h=_sha("'fault'", "truth_chain_id"))},
hit AS (SELECT victim, given FROM (SELECT *, row_number() OVER (ORDER BY {_sha("'fault-pairs'", "donor || '::' || victim")}, donor || '::' || victim) AS k FROM pairs) WHERE k <= (SELECT round_even(count(*) * 0.05, 0) FROM chains))
SELECT event_id, coalesce(given, correlation_id) AS correlation_id FROM chained LEFT JOIN hit ON victim = truth_chain_id"""
)
def fault_collision_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.collisions(_chained(spark, sf_dir), 0.05, "fault", False).select("event_id", "correlation_id")


@query(
    f"""WITH {CHAINED}, hit AS {_picked('fault', 0.1)}
SELECT event_id, source_ms + CASE WHEN event_id NOT IN (SELECT event_id FROM hit) THEN 0
  WHEN right({_sha("'fault'", "'direction'", "event_id")}, 1) IN ('1','3','5','7','9','b','d','f') THEN 5000 ELSE -5000 END AS source_ms FROM chained"""
)
def fault_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.clock_skew(_chained(spark, sf_dir), 0.1, 5000, "fault").select("event_id", "source_ms")


@query(f"WITH {CHAINED}, hit AS {_picked('fault', 0.1)} SELECT event_id, arrival_ms + CASE WHEN event_id IN (SELECT event_id FROM hit) THEN 30000 ELSE 0 END AS arrival_ms FROM chained")
def fault_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.late(_chained(spark, sf_dir), 0.1, 30_000, "fault").select("event_id", "arrival_ms")


@query(f"WITH {CHAINED} SELECT event_id, arrival_ms + {_fold(_sha(chr(39) + 'fault' + chr(39), 'event_id'), '3001')} AS arrival_ms FROM chained")
def fault_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.jitter(_chained(spark, sf_dir), 3000, "fault").select("event_id", "arrival_ms")


@query(
    f"""WITH {CHAINED}, e AS {_picked('fault', 0.1)}
SELECT event_id, payload_hash, 'canonical' AS observation_kind FROM chained
UNION ALL SELECT event_id || '-duplicate-exact', payload_hash, 'exact_duplicate' FROM chained JOIN e USING (event_id)"""
)
def fault_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.duplicates(_chained(spark, sf_dir), 0.1, "fault", False).select("event_id", "payload_hash", "observation_kind")


@query(
    f"""WITH {CHAINED}, e AS {_picked('fault', 0.05)}
SELECT event_id, payload_hash, 'canonical' AS observation_kind FROM chained
UNION ALL SELECT event_id || '-duplicate-conflict', sha256(payload_hash || '|injected-conflict'), 'conflicting_duplicate' FROM chained JOIN e USING (event_id)"""
)
def fault_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.duplicates(_chained(spark, sf_dir), 0.05, "fault", True).select("event_id", "payload_hash", "observation_kind")


@query(f"WITH {CHAINED} SELECT event_id, CASE WHEN source_type <> 'error' THEN correlation_id END AS correlation_id FROM chained")
def fault_missing_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.inject(_chained(spark, sf_dir), {"name": "fault", "kind": "missing_plane", "plane": "error"}).select("event_id", "correlation_id")


@query(
    f"""WITH {CHAINS}, lost AS {_picked('fault-missing', 0.1)}, slow AS {_picked('fault-late', 0.1)},
r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY {_sha("'fault-collision'", "service", "truth_chain_id")}, truth_chain_id) - 1 AS r FROM chains),
pairs AS (SELECT a.truth_chain_id AS donor, b.truth_chain_id AS victim, a.correlation_id AS given FROM r a JOIN r b ON a.service = b.service AND a.r % 2 = 0 AND b.r = a.r + 1),
hit AS (SELECT victim, given FROM (SELECT *, row_number() OVER (ORDER BY {_sha("'fault-collision-pairs'", "donor || '::' || victim")}, donor || '::' || victim) AS k FROM pairs) WHERE k <= (SELECT round_even(count(*) * 0.05, 0) FROM chains))
SELECT event_id, CASE WHEN event_id NOT IN (SELECT event_id FROM lost) THEN coalesce(given, correlation_id) END AS correlation_id,
  arrival_ms + CASE WHEN event_id IN (SELECT event_id FROM slow) THEN 30000 ELSE 0 END + {_fold(_sha(chr(39) + 'fault-jitter' + chr(39), 'event_id'), '3001')} AS arrival_ms FROM chained LEFT JOIN hit ON victim = truth_chain_id"""
)
def fault_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"name": "fault", "kind": "compound", "collision": 0.05, "missing": 0.1, "late": 0.1, "late_ms": 30_000, "jitter_ms": 3000}
    return faults.inject(_chained(spark, sf_dir), spec).select("event_id", "correlation_id", "arrival_ms")


@query()
def robustness_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of all metrics over all seeds, for every scenario and policy, on generated chains."""
    return campaign_summary(spark, synthetic.SEEDS, 600, 24)


METRICS = ["exact_chain_accuracy", "exact_chain_precision", "exact_chain_f1", "mean_chain_member_coverage", "missed_join_rate", "false_join_rate", "join_precision", "join_recall", "ambiguous_group_count", "ambiguous_event_rate", "accepted_ambiguous_group_count", "detected_ambiguous_group_count", "ambiguity_detection_precision", "ambiguity_detection_recall", "source_conflict_detection_precision", "source_conflict_detection_recall", "abstention_rate", "deduplication_rate", "time_to_completeness_p50_ms", "time_to_completeness_p95_ms", "time_to_completeness_max_ms"]


def campaign_trials(spark: SparkSession, seeds: tuple[int, ...], chains: int, services: int, specs: list[dict] | None = None, policies: tuple[str, ...] = tuple(reconstruct.POLICIES)) -> DataFrame:
    """One row of metrics a seed, scenario and policy. Events, assignments and metrics are stored, so no plan holds more than one of these steps."""
    by = ("seed", "scenario")
    base = stored(synthetic.observations(spark, chains, services, seeds), "campaign-base")
    events = stored(faults.campaign(base, specs), "campaign-events")
    out = None
    for name in policies:
        groups = stored(reconstruct.POLICIES[name](events, by=by, start=reconstruct.cadence()), "campaign-groups")
        part = stored(score.evaluate(events, groups, by).withColumn("algorithm", F.lit(name)), "campaign-trials")
        out = part if out is None else out.unionByName(part)
    return out


def campaign_summary(spark: SparkSession, seeds: tuple[int, ...], chains: int, services: int, specs: list[dict] | None = None, policies: tuple[str, ...] = tuple(reconstruct.POLICIES)) -> DataFrame:
    return score.summarize(campaign_trials(spark, seeds, chains, services, specs, policies), ("scenario", "algorithm"), METRICS)
