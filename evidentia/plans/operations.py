"""Queries of the store, trust, corpora, cohorts and layouts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, store
from ..sources.views import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- store ---------------------------------------------------------------------------------------------


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("t").alias("tenant_id"), F.concat(F.lit("s"), F.col("o_custkey") % 100).alias("source_id"), F.col("o_orderpriority").alias("inventory_id"), F.sha2("o_orderstatus", 256).alias("fingerprint"), F.concat_ws("-", F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("arrival"))


OFFERS = """
o AS (SELECT 's' || o_custkey % 100 AS source_id, o_orderpriority AS inventory_id, sha256(o_orderstatus) AS fingerprint, strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::VARCHAR, 9, '0') AS arrival FROM orders),
r AS (SELECT *, CASE WHEN fingerprint <> first_value(fingerprint) OVER w THEN 'inventory_id_conflict' WHEN row_number() OVER w = 1 THEN 'registered' ELSE 'duplicate' END AS status FROM o WINDOW w AS (PARTITION BY source_id, inventory_id ORDER BY arrival))"""


@query(f"WITH {OFFERS} SELECT source_id, inventory_id, arrival, status FROM r")
def inventory_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.register(_offers(spark, sf_dir)).select("source_id", "inventory_id", "arrival", "status")


@query(f"WITH {OFFERS} SELECT source_id, arg_max(inventory_id, arrival) AS inventory_id, max(arrival) AS registered_at FROM r WHERE status = 'registered' GROUP BY 1")
def latest_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = store.register(_offers(spark, sf_dir)).where("status = 'registered'").withColumnRenamed("arrival", "registered_at").drop("status")
    return store.latest(known).select("source_id", "inventory_id", "registered_at")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"), F.max("l_returnflag").alias("r"), F.max("l_shipdate").alias("d"))
    state = F.when(F.col("r") == "A", "pruned").when(F.col("r") == "R", "pending").otherwise("stored")
    return f.select((F.col("s") % 3).cast("string").alias("tenant_id"), F.col("s").cast("string").alias("source_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"), F.col("l_orderkey").alias("sequence"), state.alias("state"), F.date_format("d", "yyyy-MM-dd").alias("ingested_at"))


EVENTS = """
f AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS s, max(l_returnflag) AS r, max(l_shipdate) AS d FROM lineitem GROUP BY ALL),
e AS (SELECT (s % 3)::VARCHAR AS tenant_id, s::VARCHAR AS source_id, l_orderkey || '-' || l_linenumber AS event_id, l_orderkey AS sequence, CASE r WHEN 'A' THEN 'pruned' WHEN 'R' THEN 'pending' ELSE 'stored' END AS state, strftime(d, '%Y-%m-%d') AS ingested_at FROM f)"""


@query(
    f"""WITH {EVENTS},
c AS (SELECT tenant_id, source_id, count(*) FILTER (state = 'stored') AS stored_count, count(*) FILTER (state = 'pending') AS pending_count, count(*) FILTER (state = 'pruned') AS pruned_count, max(ingested_at) AS last_received_at,
  count(*) FILTER (sequence % 2 = 0) AS expected_count, count(*) FILTER (sequence % 2 = 0 AND state <> 'stored') AS missing_count FROM e GROUP BY ALL),
g0 AS (SELECT DISTINCT tenant_id, source_id, sequence FROM e WHERE state <> 'pruned'),
g1 AS (SELECT *, lead(sequence) OVER (PARTITION BY tenant_id, source_id ORDER BY sequence) AS n FROM g0),
g AS (SELECT tenant_id, source_id, count(*) AS gap_ranges, sum(n - sequence - 1)::BIGINT AS gap_length FROM g1 WHERE n > sequence + 1 GROUP BY ALL),
q AS (SELECT tenant_id, source_id, count(*) AS quarantine_count FROM e WHERE sequence % 97 = 0 GROUP BY ALL)
SELECT tenant_id, source_id, stored_count, pending_count, pruned_count, last_received_at, CASE WHEN expected_count > 0 THEN expected_count END AS expected_count, CASE WHEN expected_count > 0 THEN missing_count END AS missing_count, coalesce(gap_ranges, 0) AS gap_ranges, coalesce(gap_length, 0) AS gap_length, coalesce(quarantine_count, 0) AS quarantine_count,
  CASE WHEN expected_count = 0 THEN 'UNKNOWN' WHEN missing_count > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM c LEFT JOIN g USING (tenant_id, source_id) LEFT JOIN q USING (tenant_id, source_id)"""
)
def store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return store.status(e, e.where("sequence % 2 = 0"), e.where("sequence % 97 = 0"))


@query("""SELECT s_nationkey::VARCHAR AS scope, CASE WHEN s_nationkey % 7 = 6 THEN 'UNKNOWN' WHEN s_nationkey % 7 = 5 THEN 'authority not trusted' WHEN s_nationkey % 7 = 4 THEN 'scope mismatch' WHEN s_nationkey % 7 = 3 THEN 'sequence below floor' WHEN s_nationkey % 7 = 2 THEN 'evidence differs' ELSE 'VERIFIED_RELATIVE_TO_CHECKPOINT' END AS result FROM (SELECT DISTINCT s_nationkey FROM supplier)""")
def checkpoint_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of suppliers by nation against anchors; some stores were altered, some anchors don't fit."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("tenant_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("body"))
    at = "2026-01-01T00:00:00Z"
    anchors = store.checkpoint(store.material({"events": s}), "store-1", 5, at)
    n = F.col("scope").cast("int") % 7
    anchors = anchors.where(n != 6).select("scope", F.when(n == 4, "store-2").otherwise(F.col("store_id")).alias("store_id"), "checkpoint_sha256", F.when(n == 3, 6).otherwise(5).alias("minimum_sequence"), "material_sha256", (n == 5).alias("revoked"))
    altered = s.withColumn("body", F.when(F.col("tenant_id").cast("int") % 7 == 2, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return store.verified(store.checkpoint(store.material({"events": altered}), "store-1", 5, at), anchors, "2026-01-01T00:30:00Z")


@query("""SELECT c_custkey, c_custkey % 10 = 3 AND c_nationkey >= 5 AS expired, concat_ws('|', CASE WHEN c_custkey % 4 = 1 THEN 'invalid event_id' END, CASE WHEN c_custkey % 6 = 5 THEN 'invalid sequence' END, CASE WHEN c_custkey % 5 = 2 THEN 'invalid source_ts' END, CASE WHEN c_custkey % 7 = 3 THEN 'payload is no object' END) AS errors FROM customer""")
def store_event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    made = c.select("c_custkey", "c_nationkey", F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.when(k % 4 == 1, F.concat(F.lit("a"), F.char(F.lit(7)))).otherwise("ok").alias("event_id"), F.when(k % 6 == 5, -1).otherwise(k).alias("sequence"), F.when(k % 5 == 2, "2026-13-01T00:00:00Z").otherwise("2026-01-01T00:00:00.5Z").alias("source_ts"), F.when(k % 7 == 3, "[]").otherwise("{}").alias("payload"))
    return made.select("c_custkey", ((k % 10 == 3) & (F.col("c_nationkey") >= 5)).alias("expired"), F.array_join(store.event_errors(payload="payload"), "|").alias("errors"))


@query("SELECT c_custkey::VARCHAR AS subject, action, CASE WHEN c_nationkey = 3 AND ((action = 'read' AND c_mktsegment = 'BUILDING') OR (action = 'prune' AND c_mktsegment IN ('MACHINERY', 'BUILDING'))) THEN 'granted' ELSE 'denied' END AS outcome FROM customer, (SELECT unnest(['read', 'prune', 'drop']) AS action)")
def access_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("subject"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("tenant_id"), F.array("c_mktsegment").alias("roles"), F.lit("n3").alias("target_tenant"), F.lit("2026").alias("time"), F.explode(F.array(F.lit("read"), F.lit("prune"), F.lit("drop"))).alias("action"))
    return store.authorized(c, {"read": ("BUILDING",), "prune": ("MACHINERY", "BUILDING")}).select("subject", "action", "outcome")


TOKEN = "lpad('tok-' || {k}, 40, 'x')"


@query(f"""WITH p AS (SELECT sha256({TOKEN.format(k='s_suppkey % 8')}) AS h, count(*) AS n, min(s_suppkey) AS s FROM supplier WHERE s_suppkey < 12 GROUP BY 1)
SELECT c_custkey, coalesce(n = 1 AND s NOT IN (5, 6, 7) AND c_custkey % 11 <> 0, false) AS accepted, CASE WHEN n = 1 AND s NOT IN (5, 6, 7) AND c_custkey % 11 <> 0 THEN 'sub-' || s END AS subject FROM customer LEFT JOIN p ON h = sha256({TOKEN.format(k='c_custkey % 20')})""")
def token_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of customers against policies of suppliers: one is revoked, one expired, one has an unknown role, some stand twice; some tokens are too short."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey < 12")
    k, t = F.col("s_suppkey"), lambda c: F.lpad(F.concat(F.lit("tok-"), c.cast("string")), 40, "x")
    p = s.select(F.sha2(t(k % 8), 256).alias("token_sha256"), F.concat(F.lit("sub-"), k).alias("subject"), F.lit("t").alias("tenant_id"), F.when(k == 7, F.array(F.lit("root"))).otherwise(F.array(F.lit("reader"))).alias("roles"), F.when(k == 6, "2025-01-01T00:00:00Z").otherwise("2027-01-01T00:00:00Z").alias("valid_until"), (k == 5).alias("revoked"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "short").otherwise(t(F.col("c_custkey") % 20)).alias("token"))
    return store.authenticated(c, p, "2026-01-01T00:00:00Z").select("c_custkey", "accepted", "subject")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'https://host' || p_partkey || '.example' WHEN 1 THEN 'https://host.example' WHEN 2 THEN 'https://host.example:8443' WHEN 3 THEN 'https://[::1]:99' END AS origin FROM part")
def https_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    url = F.when(k % 6 == 0, F.concat(F.lit("https://HOST"), k, F.lit(".example/"))).when(k % 6 == 1, "https://host.example:443").when(k % 6 == 2, "https://host.example:8443").when(k % 6 == 3, "https://[::1]:99/").when(k % 6 == 4, "https://u:p@host.example").otherwise("http://host.example")
    return table(spark, sf_dir, "part").select("p_partkey", store.origin(url).alias("origin"))


@query("""SELECT o_orderkey, CASE WHEN k % 10 = 0 THEN 'not trusted' WHEN k % 10 = 1 THEN 'identity differs' WHEN k % 10 = 2 THEN 'outside freshness' WHEN k % 10 = 3 THEN 'origin not allowed' WHEN k % 10 = 4 THEN 'unsupported method' WHEN k % 10 = 5 THEN 'fixture forbidden' WHEN k % 10 = 6 THEN 'malformed digest' WHEN k % 10 = 7 THEN 'key not valid now' END AS error FROM (SELECT *, o_orderkey AS k FROM orders)""")
def collector_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderkey") % 10
    sha = F.sha2(F.lit("a"), 256)
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.when(d == 7, "old").when(d == 0, "none").otherwise("key").alias("key_id"), F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.when(d == 1, "other").otherwise("c").alias("collector_id"), sha.alias("adapter_sha256"), F.when(d == 2, "2026-01-01T11:50:00Z").otherwise("2026-01-01T11:59:00Z").alias("issued_at"), F.when(d == 4, "ftp").when(d == 5, "fixture").otherwise("https").alias("method"), F.when(d == 3, "https://else.example").otherwise("https://SRC.example:443/").alias("origin"), F.when(d == 6, "zz").otherwise(sha).alias("raw_sha256"))
    keys = spark.createDataFrame([("key", "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"), ("old", "2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z")], "key_id string, valid_from string, valid_until string")
    p = keys.select("key_id", F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.lit("c").alias("collector_id"), sha.alias("adapter_sha256"), "valid_from", "valid_until", F.array(F.lit("https://src.example")).alias("allowed_origins"), F.lit(False).alias("allow_fixture"), F.lit(False).alias("revoked"))
    return store.collected(s, p, "2026-01-01T12:00:00Z").select("o_orderkey", "error")


@query("""SELECT o_orderkey, CASE WHEN e = 'success' AND a = 'success' THEN 'attestation_completed_requires_verification' WHEN e = 'success' AND a <> 'odd' THEN 'attestation_' || a WHEN e <> 'success' AND a = 'skipped' THEN 'execution_' || e END AS stage
FROM (SELECT o_orderkey, (['success', 'failure', 'cancelled'])[1 + o_orderkey % 3] AS e, (['success', 'skipped', 'failure', 'odd'])[1 + o_orderkey % 4] AS a FROM orders)""")
def stage_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (F.col("o_orderkey") % len(v) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", store.stage(pick(["success", "failure", "cancelled"]), pick(["success", "skipped", "failure", "odd"])).alias("stage"))


@query("SELECT p_partkey, name, expected, observed FROM (SELECT p_partkey, 'issuer' AS name, 'i' AS expected, CASE WHEN p_partkey % 3 = 0 THEN 'j' ELSE 'i' END AS observed FROM part UNION ALL SELECT p_partkey, 'subject', 's', CASE WHEN p_partkey % 5 <> 0 THEN 's' END FROM part) WHERE expected IS DISTINCT FROM observed")
def identity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pairs = F.array(F.struct(F.lit("issuer").alias("name"), F.when(k % 3 == 0, "j").otherwise("i").alias("value")), F.struct(F.when(k % 5 == 0, "else").otherwise("subject").alias("name"), F.lit("s").alias("value")))
    seen = table(spark, sf_dir, "part").select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.*")
    return store.identity_mismatches(seen, spark.createDataFrame([("issuer", "i"), ("subject", "s")], "name string, value string"), ["p_partkey"])


# --- corpora -------------------------------------------------------------------------------------------


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


@query("WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN ' TODO /Users/ann and /home/bob, Bearer abcdefghij0123456789' ELSE '' END AS text FROM documents), f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, {_count('text', p)} AS hits FROM t" for n, p in corpus.PRIVATE.items()) + ") SELECT * FROM f WHERE hits > 0")
def private_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.when(F.col("doc_id") % 9 == 0, " TODO /Users/ann and /home/bob, Bearer abcdefghij0123456789").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), planted).alias("text"))
    return corpus.findings(docs, "doc_id", "text")


PATHS = "(['data/a' || p_partkey || '.json', '../up/' || p_partkey, '/abs/' || p_partkey, 'k/' || p_partkey || '.pem', repeat('d/', 20) || p_partkey, 'x/__pycache__/' || p_partkey])[1 + p_partkey % 6]"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    kinds = F.array(F.concat(F.lit("data/a"), k, F.lit(".json")), F.concat(F.lit("../up/"), k), F.concat(F.lit("/abs/"), k), F.concat(F.lit("k/"), k, F.lit(".pem")), F.concat(F.repeat(F.lit("d/"), 20), k), F.concat(F.lit("x/__pycache__/"), k))
    return table(spark, sf_dir, "part").select(F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("path"), F.when(F.col("p_partkey") % 7 == 0, 1 << 30).otherwise(10).cast("long").alias("size"))


@query(f"SELECT {PATHS} AS path FROM part WHERE p_partkey % 6 IN (3, 5)")
def forbidden_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.forbidden_names(_files(spark, sf_dir)).select("path")


@query(f"SELECT {PATHS} AS path, CASE WHEN p_partkey % 6 = 1 THEN 'climbs' WHEN p_partkey % 6 = 2 THEN 'not a relative path' WHEN p_partkey % 6 = 4 THEN 'too deep' ELSE 'too large' END AS error FROM part WHERE p_partkey % 6 IN (1, 2, 4) OR p_partkey % 7 = 0")
def unsafe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.unsafe_members(_files(spark, sf_dir))


@query("SELECT 2::BIGINT AS missing, 1::BIGINT AS extra, 1::BIGINT AS repeated")
def consecutive_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("id"))
    rows = n.where("id not in (4, 9)").unionByName(n.where("id = 5")).unionByName(n.where("id = 1").withColumn("id", F.lit(99).cast(n.schema["id"].dataType)))
    return corpus.consecutive(rows, "id", 25)


@query("SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 4 IN (1, 2) THEN '$.a' END, CASE WHEN p_partkey % 4 = 3 THEN '$.b.c' END) AS broken FROM part")
def typed_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit('{"a":1,"b":{"c":"x"}}'), F.lit('{"a":"1","b":{"c":"x"}}'), F.lit('{"a":true,"b":{"c":"x"}}'), F.lit('{"a":1,"b":{}}')), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return corpus.typed_contract(rows, "raw", {"$.a": 1, "$.b.c": "x"}).select("p_partkey", F.array_join("broken", "|").alias("broken"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 3 ELSE -1 END AS width, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT ELSE -1 END AS height FROM part")
def png_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    head = F.when(F.col("p_partkey") % 5 == 0, "FF504E470D0A1A0A").otherwise("89504E470D0A1A0A")
    made = F.unhex(F.concat(head, F.lit("0000000D49484452"), word(F.col("p_partkey") * 3), word(F.col("p_size"))))
    return table(spark, sf_dir, "part").select("p_partkey", corpus.png_size(made).alias("s")).select("p_partkey", F.coalesce("s.width", F.lit(-1)).alias("width"), F.coalesce("s.height", F.lit(-1)).alias("height"))


PHRASES = ["the", "License", "no text has these very words"]


@query("SELECT phrase FROM (SELECT unnest(['the', 'License', 'no text has these very words']) AS phrase) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, phrase))")
def missing_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.missing_phrases(table(spark, sf_dir, "documents"), "text", PHRASES)


@query("SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 4 = 1 THEN 'count: no whole number' END, CASE WHEN p_partkey % 4 = 2 THEN 'share: no number' END, CASE WHEN p_partkey % 4 = 3 THEN 'share: over 1' END) AS errors FROM part")
def pilot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("p_partkey") % 4
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(d == 1, "01").otherwise("12").alias("count"), F.when(d == 2, "1e-1").when(d == 3, "1.25").otherwise("0.75").alias("share"))
    return rows.select("p_partkey", F.array_join(corpus.pilot_errors("count", "share"), "|").alias("errors"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F') / nullif(sum(l_quantity), 0), 9) AS coverage, round(count(*) FILTER (l_discount > 0.05) / nullif(count(*), 0)::DOUBLE, 9) AS false_fraction FROM lineitem GROUP BY 1")
def pooled_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0).alias("c"), F.col("l_quantity").alias("w"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("f"), F.lit(1).alias("n"))
    out = corpus.pooled(rows, ["l_returnflag"], "c", "w", "f", "n")
    return out.select("l_returnflag", F.round("coverage", 9).alias("coverage"), F.round("false_fraction", 9).alias("false_fraction"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'client' END, CASE WHEN p_partkey % 4 = 0 THEN 'server' END) AS mismatch FROM part")
def version_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("1.34.2").alias("want"), F.when(k % 3 != 0, "v1.34.2").alias("c"), F.when(k % 4 == 0, "v1.34.1").otherwise("v1.34.2").alias("s"), F.lit("1.34.2").alias("n"))
    return rows.select("p_partkey", corpus.version_mismatch(rows, "want", {"client": "c", "server": "s", "node": "n"}).alias("mismatch"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'v1.33.5' WHEN 1 THEN 'v1.34.2' END AS target FROM part")
def pinned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.array(F.lit("demo-1.33-a1"), F.lit("demo-1.34-a2"), F.lit("demo-1.99-a1"), F.lit("x")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", corpus.target_of(tag, {"1.33": "v1.33.5", "1.34": "v1.34.2"}, r"\Ademo-([0-9]+\.[0-9]+)-a[0-9]+\z").alias("target"))


FOLD = "f AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)"


@query(f"""WITH {FOLD} SELECT l_orderkey AS run, count(*) AS jobs, CASE WHEN bool_or(q > 48) THEN 'failure' WHEN count(*) FILTER (l_linenumber <= 2) < 2 THEN 'incomplete' WHEN bool_or(q < 2) THEN 'cancelled' WHEN bool_or(q < 4) THEN 'skipped' ELSE 'success' END AS outcome FROM f GROUP BY 1""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    c = F.when(F.col("q") > 48, "failure").when(F.col("q") < 2, "cancelled").when(F.col("q") < 4, "skipped").otherwise("success")
    rows = f.select(F.col("l_orderkey").alias("run"), F.concat(F.lit("job"), F.col("l_linenumber")).alias("job"), c.alias("conclusion"))
    return corpus.outcomes(rows, "run", "job", "conclusion", ("job1", "job2"))


@query("SELECT o_custkey AS tag, count(*) AS invocations, count(*) = 1 AND bool_and(o_orderstatus <> 'P') AS sole FROM orders GROUP BY 1")
def sole_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tag"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("actor"))
    return corpus.sole(rows, "tag", ["actor"])


@query("SELECT n_nationkey AS position, n_name AS expected, CASE WHEN n_nationkey < 20 THEN upper(n_name) || CASE WHEN n_nationkey % 6 = 0 THEN '?' ELSE '' END END AS observed FROM nation WHERE n_name IS DISTINCT FROM CASE WHEN n_nationkey < 20 THEN upper(n_name) || CASE WHEN n_nationkey % 6 = 0 THEN '?' ELSE '' END END")
def run_set_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("run"))
    seen = n.where("position < 20").withColumn("run", F.concat(F.upper("run"), F.when(F.col("position") % 6 == 0, "?").otherwise("")))
    return corpus.order_differences(n, seen, "position", "run")


@query("""WITH w AS (SELECT r AS region, t AS trial FROM (SELECT unnest(range(5)) AS r), (SELECT unnest(range(1, 5)) AS t)), g AS (SELECT n_regionkey AS region, n_nationkey % 6 AS trial, count(*) AS n FROM nation GROUP BY ALL)
SELECT region, trial, CASE WHEN n IS NULL THEN 'missing' WHEN trial NOT BETWEEN 1 AND 4 OR region NOT BETWEEN 0 AND 4 THEN 'extra' ELSE 'repeated' END AS status FROM w FULL JOIN g USING (region, trial) WHERE n IS NULL OR n > 1 OR trial NOT BETWEEN 1 AND 4""")
def design_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("region"), (F.col("n_nationkey") % 6).cast("long").alias("trial"))
    return corpus.design_differences(n, {"region": [0, 1, 2, 3, 4], "trial": [1, 2, 3, 4]})


@query("""WITH p AS (SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_acctbal > 0) AS good FROM supplier GROUP BY 1)
SELECT count(*) AS versions, count(*) FILTER (n = 4 AND good = 4) AS complete_versions, sum(n)::BIGINT AS runs, sum(good)::BIGINT AS good_runs, CASE WHEN count(*) FILTER (n = 4 AND good = 4) = count(*) THEN 'complete_success' WHEN sum(good) = 0 THEN 'failed' ELSE 'partial' END AS status FROM p""")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("version"), (F.col("s_acctbal") > 0).alias("ok"))
    return corpus.cohort_summary(rows, "version", "ok", 4)


@query(f"""WITH {FOLD}, a AS (SELECT l_orderkey AS run, count(*) AS attempts, arg_min(q > 25, l_linenumber) AS f, arg_max(q > 25, l_linenumber) AS l FROM f GROUP BY 1)
SELECT run, attempts, CASE WHEN f THEN 'success' ELSE 'failure' END AS first, CASE WHEN l THEN 'success' ELSE 'failure' END AS last, NOT f AND l AS recovered FROM a""")
def run_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return corpus.attempts(f.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("attempt"), F.when(F.col("q") > 25, "success").otherwise("failure").alias("c")), "run", "attempt", "c")


@query("SELECT count(*) AS input, count(*) FILTER (o_orderstatus = 'F') AS retained, count(*) FILTER (o_orderstatus <> 'F') AS excluded, true AS balanced FROM orders")
def reprocessing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.col("o_orderstatus") == "F"
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("input"), one.cast("int").alias("retained"), (~one).cast("int").alias("excluded"))
    return corpus.totals(rows, "input", ["retained", "excluded"])


@query("SELECT p_brand, sum(p_size)::BIGINT AS bytes, count(*) AS pages FROM part GROUP BY 1")
def object_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.object_sizes(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT n_nationkey AS trial, i::INTEGER AS position, (['none', 'service', 'correlation', 'full'])[1 + (n_nationkey + i) % 4] AS variant FROM nation, (SELECT unnest(range(4)) AS i)")
def balanced_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rotation(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("trial")), "trial", ["none", "service", "correlation", "full"])


@query("SELECT event_id, CASE WHEN event_id % 100 = 7 THEN 'lost' ELSE 'counted twice' END AS status FROM events WHERE event_id % 100 IN (7, 9) UNION ALL SELECT -1, 'unknown'")
def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    assigned = e.where("event_id % 3 <> 0 and event_id % 100 <> 7").unionByName(e.where("event_id % 100 = 9")).unionByName(spark.createDataFrame([(-1,)], e.schema))
    return corpus.accounting(e, assigned, e.where("event_id % 3 = 0 and event_id % 100 <> 7"), "event_id")


@query("""WITH h AS (SELECT event_id, sha256('7' || chr(31) || 'loss' || chr(31) || event_id) AS h, sha256('7' || chr(31) || 'loss-retry' || chr(31) || event_id) AS r FROM events),
k AS (SELECT *, row_number() OVER (ORDER BY h, event_id) AS n FROM h),
f AS (SELECT *, list_reduce([0::BIGINT, """ + ", ".join(f"('0x' || substr(r, {8 * i + 1}, 8))::BIGINT" for i in range(8)) + """], lambda a, x: (a * 4294967296 + x) % 7) AS m FROM k)
SELECT event_id, CASE WHEN n <= (SELECT round_even(count(*) * 0.2, 0) FROM h) THEN 'dropped_then_recovered' WHEN m = 0 THEN 'sent_twice' ELSE 'sent' END AS phase FROM f""")
def lossy_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.deliveries(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.2, 7, "loss", 7).select("event_id", "phase")
