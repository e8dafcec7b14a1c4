"""Queries of cross-plane joins, privacy, the ledger and verification, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, crossplane, ledger, privacy, verify
from ..sources.views import CLAIMS, claims, table
from ..streaming import live
from .evidence import EVIDENCE, evidence

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- cluster audit records made from events -----------------------------------------------------------


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as audit records in JSON: every fourth is a 403 without its object's annotation."""
    e = table(spark, sf_dir, "events")
    denied = F.col("event_id") % 4 == 0
    corr = F.concat(F.lit("ord-"), (F.col("user_id") % 400).cast("string"))
    meta = F.struct(F.struct(F.create_map(F.lit("app.kubernetes.io/name"), F.concat(F.lit("app-"), F.col("user_id") % 9)).alias("labels"), F.create_map(F.lit(crossplane.ANNOTATION), corr).alias("annotations")).alias("metadata"))
    raw = F.to_json(
        F.struct(
            F.concat(F.lit("a-"), F.col("event_id")).alias("auditID"),
            F.lit("ResponseComplete").alias("stage"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stageTimestamp"),
            F.col("event_type").alias("verb"),
            F.concat(F.lit("/apis/apps/v1/namespaces/ns-"), F.col("user_id") % 5, F.lit("/deployments")).alias("requestURI"),
            F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("username")).alias("user"),
            F.struct(F.lit("apps").alias("apiGroup"), F.lit("deployments").alias("resource"), F.concat(F.lit("d"), F.col("user_id") % 400).alias("name")).alias("objectRef"),
            F.when(~denied, meta).alias("requestObject"),
            F.struct(F.when(denied, 403).otherwise(201).alias("code"), F.when(denied, "Forbidden").alias("reason")).alias("responseStatus"),
        )
    )
    return e.select("event_id", raw.alias("raw"))


AUDIT = f"""
audit AS (
  SELECT event_id, 'a-' || event_id || ':ResponseComplete' AS source_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS source_ts, 'u' || user_id AS actor, event_type AS action,
    event_id % 4 = 0 AS denied, 'ns-' || user_id % 5 AS namespace, 'd' || user_id % 400 AS name, user_id % 9 AS app, 'ord-' || user_id % 400 AS corr FROM events),
mapped AS (
  SELECT source_id, source_ts, actor, action, namespace || '/' || CASE WHEN denied THEN name ELSE 'app-' || app END AS service,
    CASE WHEN denied THEN '403:Forbidden' ELSE '201' END AS outcome, namespace, name, denied, corr,
    CASE WHEN denied THEN '{"k8s://"}' || namespace || '/deployments/' || name ELSE corr END AS correlation_id FROM audit)"""


@query(f"WITH {AUDIT} SELECT source_id, source_ts, actor, action, service, outcome, correlation_id FROM mapped")
def audit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossplane.audit_evidence(audit(spark, sf_dir)).select("source_id", "source_ts", "actor", "action", "service", "outcome", "correlation_id")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments that orders stand for, with their correlation."""
    n = F.col("o_orderkey") % 400
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return o.select(F.lit("apps").alias("api_group"), F.lit("deployments").alias("resource"), F.concat(F.lit("ns-"), n % 5).alias("namespace"), F.concat(F.lit("d"), n).alias("name"), F.concat(F.lit("ord-"), n).alias("correlation_id")).distinct()


@query(
    f"""WITH {AUDIT}, t AS (SELECT DISTINCT 'ns-' || (o_orderkey % 400) % 5 AS namespace, 'd' || o_orderkey % 400 AS name, 'ord-' || o_orderkey % 400 AS given FROM orders WHERE o_orderkey % 3 = 0)
SELECT source_id, CASE WHEN NOT denied THEN 'source_native_object_annotation' WHEN given IS NOT NULL THEN 'adapter_explicit_exact_target' ELSE 'absent' END AS binding,
  CASE WHEN NOT denied THEN corr ELSE given END AS bound_correlation FROM mapped LEFT JOIN t USING (namespace, name)"""
)
def target_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crossplane.audit_evidence(audit(spark, sf_dir))
    return crossplane.bound(rows, _targets(spark, sf_dir)).select("source_id", "binding", "bound_correlation")


CROSS = AUDIT + ", " + EVIDENCE.strip() + """,
d AS (SELECT correlation_id, count(*) AS delivery_records FROM evidence WHERE source_type = 'recovery' GROUP BY ALL),
c AS (SELECT correlation_id, count(*) AS cluster_records FROM mapped GROUP BY ALL),
report AS (SELECT correlation_id, delivery_records, coalesce(cluster_records, 0) AS cluster_records, CASE WHEN cluster_records > 0 THEN 'exact_join_observed' ELSE 'not_observed' END AS status FROM d LEFT JOIN c USING (correlation_id))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossplane.joined(evidence(spark, sf_dir).where("source_type = 'recovery'"), crossplane.audit_evidence(audit(spark, sf_dir)))


@query(f"WITH {CROSS} SELECT * FROM report WHERE status = 'exact_join_observed'")
def crossplane_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).where("status = 'exact_join_observed'")


@query(f"WITH {CROSS} SELECT status, count(*) AS correlations, sum(delivery_records)::BIGINT AS records FROM report GROUP BY status")
def crossplane_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).groupBy("status").agg(F.count("*").alias("correlations"), F.sum("delivery_records").alias("records"))


# --- privacy -------------------------------------------------------------------------------------------

ALLOWED = {"status": "[FOP]", "priority": "[1-3]-[A-Z]+"}


def _public(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("customer")))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


@query("SELECT path, reason, count(*) AS dropped FROM (SELECT '*' AS path, 'not_allowlisted' AS reason FROM orders UNION ALL SELECT 'priority', 'invalid_value' FROM orders WHERE NOT regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+')) GROUP BY ALL")
def drop_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.drops(_public(spark, sf_dir), "raw", ALLOWED)


@query("""SELECT o_orderkey, '{' || CASE WHEN regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+') THEN '"priority":"' || o_orderpriority || '",' ELSE '' END || '"status":"' || o_orderstatus || '"}' AS public FROM orders""")
def allowlist_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(spark, sf_dir).select("o_orderkey", privacy.allowed_json(F.col("raw"), ALLOWED).alias("public"))


@query()
def json_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.redacted_json(audit(spark, sf_dir), "raw").select("event_id", "redacted")


# --- ledger --------------------------------------------------------------------------------------------


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    return c.select(F.lit("t").alias("tenant_id"), F.col("source_id").cast("string").alias("source_id"), F.col("sequence").cast("string").alias("event_id"), "sequence", "fingerprint", F.concat("received", "fingerprint").alias("arrival"))


DECIDED = CLAIMS + """,
decided AS (
  SELECT source_id::VARCHAR AS source_id, sequence, fingerprint, received || fingerprint AS arrival,
    CASE WHEN row_number() OVER w = 1 THEN 'queued' WHEN fingerprint = first_value(fingerprint) OVER w THEN 'duplicate' ELSE 'event_id_conflict' END AS decision
  FROM claims WINDOW w AS (PARTITION BY source_id, sequence ORDER BY received || fingerprint))"""


@query(f"WITH {DECIDED} SELECT source_id, sequence, fingerprint, decision FROM decided")
def ingest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.decide(_batch(spark, sf_dir)).select("source_id", "sequence", "fingerprint", "decision")


@query(f"WITH {DECIDED} SELECT source_id, count(*) AS conflicts FROM decided WHERE decision = 'event_id_conflict' GROUP BY source_id")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.quarantined(ledger.decide(_batch(spark, sf_dir))).groupBy("source_id").agg(F.count("*").alias("conflicts"))


@query(f"WITH {DECIDED} SELECT source_id, sequence FROM decided WHERE decision = 'queued' ORDER BY arrival, source_id, sequence LIMIT 500")
def drain_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = ledger.decide(_batch(spark, sf_dir)).where("decision = 'queued'").withColumn("state", F.lit("pending"))
    return ledger.drain(pending, 500, ("arrival", "source_id", "sequence")).select("source_id", "sequence")


@query(f"WITH {DECIDED}, q AS (SELECT source_id, sequence, row_number() OVER (ORDER BY arrival, source_id, sequence) AS r FROM decided WHERE decision = 'queued') SELECT count(*) FILTER (r <= 20000) AS queued, count(*) FILTER (r > 20000) AS queue_full FROM q")
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the queue took and events that it refused, each once however often it arrived again."""
    out = ledger.decide(_batch(spark, sf_dir), max_pending=20_000)
    events = out.where("decision in ('queued', 'queue_full')").select("decision", "source_id", "event_id").distinct()
    return events.agg(F.expr("count_if(decision = 'queued')").alias("queued"), F.expr("count_if(decision = 'queue_full')").alias("queue_full"))


INVENTORY = """
e AS (SELECT o_custkey, o_orderkey FROM orders),
s AS (SELECT DISTINCT o_custkey, l_orderkey AS o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N')"""


def _inventory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return orders, lines.join(orders, "o_orderkey")


@query(
    f"""WITH {INVENTORY} SELECT o_custkey, count(DISTINCT e.o_orderkey) AS expected_count, count(DISTINCT s.o_orderkey) AS stored_count, count(DISTINCT e.o_orderkey) - count(DISTINCT s.o_orderkey) AS missing_count,
  CASE WHEN count(DISTINCT e.o_orderkey) > count(DISTINCT s.o_orderkey) THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM e LEFT JOIN s USING (o_custkey, o_orderkey) GROUP BY o_custkey"""
)
def inventory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, stored = _inventory(spark, sf_dir)
    return ledger.completeness(expected, stored, ["o_custkey"], "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.select("o_orderkey").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS n FROM lineitem), x AS (SELECT *, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS m FROM s) SELECT l_orderkey, n + 1 AS first_missing, m - 1 AS last_missing FROM x WHERE m > n + 1")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("sequence"))
    return ledger.gaps(rows, ["l_orderkey"])


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("stored")
    return o.select(F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.col("o_orderkey").cast("string").alias("event_id"), state.alias("state"), (F.col("o_custkey") % 10 == 0).alias("held"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ingested_at"), F.col("o_orderpriority").alias("payload"))


@query("""SELECT o_orderkey::VARCHAR AS event_id, CASE WHEN gone THEN 'pruned' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'stored' END AS state, CASE WHEN NOT gone THEN o_orderpriority END AS payload
FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') < '1998-01-01' AND o_custkey % 10 <> 0 AS gone FROM orders)""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.prune(_ledger(spark, sf_dir), F.lit("1998-01-01")).select("event_id", "state", "payload")


@query("SELECT count(*) FILTER (o_custkey % 10 = 0 OR o_orderkey % 100 = 1) AS held, count(*) FILTER (NOT (o_custkey % 10 = 0 OR o_orderkey % 100 = 1)) AS free FROM orders")
def hold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir)
    ids = rows.where("cast(event_id as long) % 100 = 1")
    return ledger.hold(rows, ids).agg(F.count_if("held").alias("held"), F.expr("count_if(not held)").alias("free"))


@query("SELECT c_custkey, (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3) AS allowed FROM customer")
def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_mktsegment").alias("roles"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("tenant_id"))
    return c.select("c_custkey", ledger.allowed(c, "roles", ["BUILDING", "MACHINERY"], "n3").alias("allowed"))


@query("WITH p AS (SELECT sha256('tok-' || s_suppkey) AS token, s_suppkey FROM supplier) SELECT c_custkey, p.s_suppkey IS NOT NULL AS accepted FROM customer LEFT JOIN p ON token = sha256('tok-' || c_custkey)")
def token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presented tokens against stored hashes: exactly one policy must match."""
    policy = table(spark, sf_dir, "supplier").select(F.sha2(F.concat(F.lit("tok-"), F.col("s_suppkey")), 256).alias("token"))
    policy = policy.groupBy("token").agg(F.count("*").alias("n")).where("n = 1")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat(F.lit("tok-"), F.col("c_custkey")), 256).alias("token"))
    return c.join(policy, "token", "left").select("c_custkey", F.col("n").isNotNull().alias("accepted"))


@query()
def sealed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that open under their own identity, and those that open under another's (none)."""
    key = bytes(range(32))
    rows = _ledger(spark, sf_dir).select("event_id", "payload", ledger.seal(F.col("payload"), key, F.col("event_id")).alias("sealed"))
    own, other = ledger.unseal(F.col("sealed"), key, F.col("event_id")), ledger.unseal(F.col("sealed"), key, F.concat("event_id", F.lit("x")))
    return rows.agg(F.count_if(own.cast("string") == F.col("payload")).alias("opened"), F.count_if(other.isNotNull()).alias("stolen"))


# --- verification --------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT p_partkey, p_brand, p_type, p_size FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE p_brand END AS p_brand, p_type, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 50 <> 0),
m AS (SELECT unnest([{'f': 'p_brand', 's': a.p_brand = b.p_brand}, {'f': 'p_type', 's': a.p_type = b.p_type}, {'f': 'p_size', 's': a.p_size = b.p_size}]) AS m FROM a JOIN b USING (p_partkey))
SELECT m.f AS field, count(*) AS compared, count(*) FILTER (m.s) AS equal, round(count(*) FILTER (m.s) / count(*)::DOUBLE, 9) AS accuracy FROM m GROUP BY m.f"""
)
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    b = a.where("p_partkey % 50 <> 0").withColumns({"p_brand": F.when(k % 10 == 0, "x").otherwise(F.col("p_brand")), "p_size": F.when(k % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))})
    return verify.field_accuracy(a, b, "p_partkey", ["p_brand", "p_type", "p_size"]).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'changed' END AS status FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 7 = 0 UNION ALL SELECT -p_partkey - 1, 'extra' FROM part WHERE p_partkey % 90 = 0")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"))
    b = a.where("p_partkey % 50 <> 0").withColumn("digest", F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("digest")))
    b = b.unionByName(a.where("p_partkey % 90 = 0").withColumn("p_partkey", -F.col("p_partkey") - 1))
    return verify.manifest_diff(a, b, "p_partkey")


@query("SELECT count(*) AS n, round(avg(toxic - quality), 9) AS mean_difference, median(toxic - quality)::DOUBLE AS median_difference FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def paired_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    rows = labels.select("doc_id", F.explode(F.array(F.struct(F.lit("baseline").alias("method"), F.col("quality").alias("value")), F.struct(F.lit("treatment").alias("method"), F.col("toxic").alias("value")))).alias("m")).select("doc_id", "m.*")
    return verify.paired(rows, "doc_id", "method", "value", ("baseline", "treatment")).withColumn("mean_difference", F.round("mean_difference", 9))


@query("SELECT s_nationkey AS version, count(*) AS runs, count(*) FILTER (s_acctbal > 0) AS complete, CASE WHEN count(*) = 4 AND count(*) FILTER (s_acctbal > 0) = 4 THEN 'complete_success' WHEN count(*) FILTER (s_acctbal > 0) = 0 THEN 'failed' ELSE 'partial' END AS status FROM supplier GROUP BY 1")
def cohort_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("version"), (F.col("s_acctbal") > 0).alias("ok"))
    return verify.cohort(rows, "version", "ok", 4)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, round(q / nullif(max(CASE WHEN l_returnflag = 'A' THEN q END) OVER (PARTITION BY l_orderkey, l_linenumber), 0), 9) AS ratio FROM (SELECT l_orderkey, l_linenumber, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)")
def ratio_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return verify.ratio_to_reference(rows, ["l_orderkey", "l_linenumber"], "l_returnflag", "A", "q").select("l_orderkey", "l_linenumber", "l_returnflag", F.round("ratio", 9).alias("ratio"))


# --- queue, retention and recovery ---------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS event_id, CASE WHEN o_orderstatus <> 'P' OR r <= 20 THEN 'stored' ELSE 'pending' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey::VARCHAR) AS r FROM orders)")
def drained_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.drained(_ledger(spark, sf_dir), 20).select("event_id", "state")


@query("SELECT 't' AS tenant_id, 'retention' AS reason, count(*) FILTER (o_custkey % 10 <> 0) AS deleted_count, count(*) FILTER (o_custkey % 10 = 0) AS held_count FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1998-01-01'")
def retention_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.receipts(_ledger(spark, sf_dir), F.lit("1998-01-01"), "retention").drop("deleted_sha256")


@query(
    """WITH s AS (SELECT (o_orderkey % 50)::VARCHAR AS event_id, o_orderkey AS n FROM orders WHERE o_orderkey < 500),
f AS (SELECT event_id, min(n) AS first FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY first) AS r FROM f)
SELECT s.n AS arrival, CASE WHEN r > 30 THEN 'queue_full' WHEN s.n = first THEN 'queued' ELSE 'duplicate' END AS decision FROM s JOIN k USING (event_id)"""
)
def refused_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty events sent again and again to a queue of thirty: what was refused is refused at each retry."""
    o = table(spark, sf_dir, "orders").where("o_orderkey < 500")
    event = (F.col("o_orderkey") % 50).cast("string")
    batch = o.select(F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), event.alias("event_id"), (F.col("o_orderkey") % 50).cast("long").alias("sequence"), F.sha2(event, 256).alias("fingerprint"), F.col("o_orderkey").alias("arrival"))
    return ledger.decide(batch, max_pending=30).select("arrival", "decision")


@query("SELECT count(*) AS events, round_even(count(*) * 0.2, 0)::BIGINT AS dropped, count(*) AS stored_once FROM events")
def loss_and_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lossy delivery, its repeats and its recovery after a restart leave every event in the ledger exactly once."""
    sent = corpus.deliveries(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("sequence")), "event_id", 0.2, 7, "loss", 7)
    times = F.when(F.col("phase") == "sent_twice", F.array(F.lit("1"), F.lit("2"))).when(F.col("phase") == "sent", F.array(F.lit("1"))).otherwise(F.array(F.lit("3")))
    arrivals = sent.select(F.lit("t").alias("tenant_id"), F.concat(F.lit("s"), F.col("sequence") % 16).alias("source_id"), "event_id", "sequence", F.sha2("event_id", 256).alias("fingerprint"), F.explode(times).alias("round"), "turn", "phase")
    decided = ledger.decide(arrivals.withColumn("arrival", F.concat("round", "turn")))
    rows = decided.groupBy("event_id").agg(F.count_if(F.col("decision") == "queued").alias("q"), F.count_if(~F.col("decision").isin("queued", "duplicate")).alias("bad"))
    lost = sent.agg(F.count("*").alias("events"), F.count_if(F.col("phase") == "dropped_then_recovered").alias("dropped"))
    return lost.crossJoin(rows.agg(F.expr("count_if(q = 1 and bad = 0)").alias("stored_once")))


@query("SELECT event_id FROM events WHERE event_id % 7 NOT IN (1, 5)")
def freshness_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("event_id") % 7
    seconds = F.when(d == 1, -301).when(d == 5, 31).when(d == 2, -300).when(d == 3, 30).otherwise(0)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("received")).withColumn("observed", F.col("received") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))
    return live.fresh(rows, "observed", "received").select("event_id")


@query("SELECT event_id, '{\"a\":{\"mountPath\":\"<redacted-absolute-path>\",\"note\":\"see <redacted-local-path> now\"},\"requestURI\":\"/api/' || event_id || '\",\"secret\":[{\"token\":\"<redacted-sensitive-value>\"}],\"serviceAccountToken\":\"<redacted-service-account-token-projection>\"}' AS redacted FROM events")
def redaction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"sourceIPs":["10.0.0.1"],"requestURI":"/api/'), F.col("event_id").cast("string"), F.lit('","a":{"mountPath":"/var/run","note":"see /home/me/x now"},"secret":[{"token":"t"}],"serviceAccountToken":{"path":"p"}}'))
    return privacy.redacted_json(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw").select("event_id", "redacted")


@query("""WITH a AS (SELECT event_type AS verb, user_id, event_id % 4 = 0 AS denied FROM events)
SELECT count(*) AS records, count(DISTINCT user_id) AS actors, count(*) FILTER (denied) AS denials, (SELECT string_agg(verb || '=' || n, ',' ORDER BY verb) FROM (SELECT verb, count(*) AS n FROM a GROUP BY 1)) AS verbs,
  '201=' || count(*) FILTER (NOT denied) || ',403=' || count(*) FILTER (denied) AS codes FROM a""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about audit records: totals, and counts by verb and by status."""
    rows = crossplane.audit_evidence(audit(spark, sf_dir)).select("actor", "action", "code")
    fine = rows.groupBy("action", "code", "actor").agg(F.count("*").alias("n"))
    said = lambda c: fine.groupBy(F.col(c).cast("string").alias("k")).agg(F.sum("n").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", F.col("n").cast("string")))), ","))
    total = fine.agg(F.sum("n").alias("records"), F.count_distinct("actor").alias("actors"), F.sum(F.when(F.col("code") == 403, F.col("n")).otherwise(0)).alias("denials"))
    # each is one row
    return total.crossJoin(said("action").toDF("verbs")).crossJoin(said("code").toDF("codes"))
