"""Queries of evidence normalization, lookup and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bare_url, namespace, redacted
from ..operators import links, normalize, verify
from ..sources import synthetic
from ..sources.views import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Which kind of event stands for which plane.
PLANE_OF = {"click": "deployment", "signup": "identity", "purchase": "policy", "view": "telemetry", "error": "incident"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events and orders under the roles' names, with the plane of each."""
    k = F.get_json_object("props", "$.k").cast("long")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    svc = lambda c: F.concat(F.lit("svc-"), F.lpad((F.col(c) % 50).cast("string"), 4, "0"))
    corr = F.when(k % 10 != 0, F.concat(F.lit("corr-"), F.lpad(k.cast("string"), 4, "0"), F.lit("-"), F.date_format("ts", "yyyyMMdd")))
    plane = F.create_map(*[F.lit(x) for p in PLANE_OF.items() for x in p])
    events = table(spark, sf_dir, "events").select(F.element_at(plane, F.col("event_type")).alias("source_type"), F.col("event_id").alias("source_id"), at("ts").alias("source_ts"), F.concat(F.lit("user-"), F.col("user_id")).alias("actor"), svc("user_id").alias("service"), F.concat(F.lit("rule-"), k % 7).alias("policy"), F.col("event_type").alias("action"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), F.concat(F.lit("urn:evt:"), F.col("event_id")).alias("source_pointer"), F.coalesce(corr, F.lit("")).alias("correlation_id"))
    orders = table(spark, sf_dir, "orders").select(F.lit("recovery").alias("source_type"), F.col("o_orderkey").alias("source_id"), at("o_orderdate").alias("source_ts"), F.concat(F.lit("cust-"), F.col("o_custkey")).alias("actor"), svc("o_custkey").alias("service"), F.col("o_orderpriority").alias("policy"), F.lit("order").alias("action"), F.col("o_orderstatus").alias("outcome"), F.concat(F.lit("urn:ord:"), F.col("o_orderkey")).alias("source_pointer"), F.concat(F.lit("ord-"), F.col("o_orderkey")).alias("correlation_id"))
    return events.unionByName(orders)


_CASE = " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in PLANE_OF.items())
_INTENT = " ".join(f"WHEN '{p}' THEN '{r[8]}'" for p, r in synthetic.ROLES.items())
_VALUES = ", ".join("source_id" if c == "source_id" else f"'\"' || {c} || '\"'" for c in normalize.EVIDENCE[:-1])
EVIDENCE = f"""
base AS (
  SELECT CASE event_type {_CASE} END AS source_type, event_id AS source_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS source_ts, 'user-' || user_id AS actor,
    'svc-' || lpad((user_id % 50)::VARCHAR, 4, '0') AS service, 'rule-' || ((props->>'$.k')::BIGINT % 7) AS policy, event_type AS action,
    CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, 'urn:evt:' || event_id AS source_pointer,
    CASE WHEN (props->>'$.k')::BIGINT % 10 <> 0 THEN 'corr-' || lpad(props->>'$.k', 4, '0') || '-' || strftime(ts, '%Y%m%d') ELSE '' END AS correlation_id
  FROM events
  UNION ALL
  SELECT 'recovery', o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ'), 'cust-' || o_custkey, 'svc-' || lpad((o_custkey % 50)::VARCHAR, 4, '0'),
    o_orderpriority, 'order', o_orderstatus, 'urn:ord:' || o_orderkey, 'ord-' || o_orderkey FROM orders),
rows_ AS (SELECT *, source_ts AS observed_ts, CASE source_type {_INTENT} END AS intent FROM base),
evidence AS (
  SELECT source_type, source_id, source_ts, observed_ts, actor, service, intent, policy, action, outcome, source_pointer, correlation_id,
    sha256('[' || concat_ws(',', {_VALUES}) || ']') AS content_hash FROM rows_)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planes in one projection: one scan of each table, whose filters reach it."""
    return normalize.projected(base(spark, sf_dir))


@query(f"WITH {EVIDENCE} SELECT * FROM evidence")
def evidence_full_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)


@query(f"WITH {EVIDENCE} SELECT * FROM evidence WHERE service = 'svc-0007' ORDER BY source_ts, source_type, source_id")
def evidence_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.lookup(evidence(spark, sf_dir), "service", "svc-0007")


@query(f"WITH {EVIDENCE} SELECT * FROM evidence WHERE correlation_id = 'ord-1001'")
def evidence_by_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.lookup(evidence(spark, sf_dir), "correlation_id", "ord-1001")


@query(f"WITH {EVIDENCE} SELECT source_type, source_id, content_hash FROM evidence")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("source_type", "source_id", "content_hash")


@query(f"WITH {EVIDENCE} SELECT 0::BIGINT AS left_only, 0::BIGINT AS right_only, count(*) AS left_rows, count(*) AS right_rows FROM evidence")
def layout_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by which the six projected source tables differ from one projection of their union, and how many both have."""
    six = normalize.unified(synthetic.fragmented(base(spark, sf_dir)))
    return normalize.equal_layouts(six, evidence(spark, sf_dir))


@query(f"WITH {EVIDENCE} SELECT source_type, outcome, count(*) AS n FROM evidence GROUP BY ALL")
def plane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).groupBy("source_type", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {EVIDENCE} SELECT count(*) AS n, count(DISTINCT content_hash) AS hashes, count(DISTINCT service) AS services, count(DISTINCT correlation_id) AS correlations FROM evidence")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("hashes"), F.count_distinct("service").alias("services"), F.count_distinct("correlation_id").alias("correlations"))


@query(f"WITH {EVIDENCE} SELECT service, count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (correlation_id = '') AS uncorrelated, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS planes FROM evidence GROUP BY service")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).groupBy("service").agg(F.expr("count_if(outcome = 'failure')").alias("failures"), F.expr("count_if(correlation_id = '')").alias("uncorrelated"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("planes"))


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS min_, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median_, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max_, round(avg(value), 6) AS mean_ FROM events GROUP BY event_type")
def value_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.min("value"), "min_"), r(F.percentile("value", 0.25), "q1"), r(F.median("value"), "median_"), r(F.percentile("value", 0.75), "q3"), r(F.max("value"), "max_"), r(F.avg("value"), "mean_"))


@query()
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.table_digest(evidence(spark, sf_dir))


@query()
def synthetic_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated six-plane table of the size that the published lookups use, unified."""
    return normalize.unified(synthetic.fragmented(synthetic.planes(spark, 100_000, 200, 9137)))


# --- scalar rules over pages and texts --------------------------------------------------------------


@query(r"""SELECT page_id, CASE WHEN regexp_extract(url, '\A(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]+)?(/[^?#]*)?', 2) <> '' THEN
  regexp_extract(url, '\A(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]+)?(/[^?#]*)?', 1) || '://' || lower(regexp_extract(url, '\A(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]+)?(/[^?#]*)?', 2))
  || regexp_extract(url, '\A(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]+)?(/[^?#]*)?', 3) || regexp_extract(url, '\A(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]+)?(/[^?#]*)?', 4) END AS bare FROM pages""")
def url_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", bare_url(F.col("url")).alias("bare"))


@query(r"""SELECT event_id, coalesce(CASE WHEN user_id % 3 = 0 THEN 'ns-' || user_id % 5 END, nullif(regexp_extract('/api/v1/namespaces/u' || user_id || '/pods', '/namespaces/([^/?]*)', 1), '')) AS namespace FROM events""")
def namespace_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("ns-"), F.col("user_id") % 5))
    uri = F.concat(F.lit("/api/v1/namespaces/u"), F.col("user_id"), F.lit("/pods"))
    return table(spark, sf_dir, "events").select("event_id", namespace(named, uri).alias("namespace"))


@query(r"""SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), 'Bearer [A-Za-z0-9._~+/=-]+', 'Bearer [token]', 'g'), '/(Users|home)/[A-Za-z0-9._-]+', '/[home]', 'g')) AS digest FROM conversations""")
def redact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(redacted(F.col("text")), 256).alias("digest"))


# --- links -------------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as records with one link, a second for every seventh, a wrong one for every eleventh."""
    e = evidence(spark, sf_dir)
    n = F.col("source_id")
    link = lambda kind, value, method, conf: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("custom_type"), value.alias("value"), F.struct(F.lit("namespace").alias("type"), F.col("service").alias("id")).alias("scope"), F.lit(method).alias("evidence_method"), conf.alias("confidence"))
    none = F.lit(None).cast("double")
    first = F.when(F.col("correlation_id") != "", link("correlation_id", F.col("correlation_id"), "source_native", none))
    second = F.when(n % 7 == 0, link("correlation_id", F.concat(F.lit("alt-"), (n % 13).cast("string")), "adapter_explicit", none))
    third = F.when(n % 11 == 0, link("guess", F.lit("x"), "inferred", none))
    return e.withColumn("links", F.array_compact(F.array(first, second, third)).cast(links.LINK))


LINKS = (
    EVIDENCE
    + """,
link AS (
  SELECT source_type, source_id, service, 'correlation_id' AS type, correlation_id AS value, 'source_native' AS method, 0 AS slot FROM evidence WHERE correlation_id <> ''
  UNION ALL SELECT source_type, source_id, service, 'correlation_id', 'alt-' || source_id % 13, 'adapter_explicit', 1 FROM evidence WHERE source_id % 7 = 0
  UNION ALL SELECT source_type, source_id, service, 'guess', 'x', 'inferred', 2 FROM evidence WHERE source_id % 11 = 0)"""
)


@query(f"WITH {LINKS} SELECT source_type, source_id, (row_number() OVER (PARTITION BY source_type, source_id ORDER BY slot) - 1)::INTEGER AS position, type, 'namespace' AS scope_type, service AS scope_id, value, method AS evidence_method FROM link")
def link_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.exploded(records(spark, sf_dir)).select("source_type", "source_id", "position", "type", "scope_type", "scope_id", "value", "evidence_method")


@query(
    f"""WITH {LINKS}, placed AS (SELECT *, row_number() OVER (PARTITION BY source_type, source_id ORDER BY slot) - 1 AS position FROM link),
bad AS (SELECT source_type, source_id, 'links[' || position || '].type: unsupported|links[' || position || '].confidence: required in [0, 1]' AS e FROM placed WHERE type = 'guess')
SELECT source_type, source_id, coalesce(e, '') AS errors FROM evidence LEFT JOIN bad USING (source_type, source_id)"""
)
def link_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("source_type", "source_id", F.array_join(links.errors(), "|").alias("errors"))


@query(
    f"""WITH {LINKS}, known AS (SELECT DISTINCT source_type, source_id, service, value FROM link WHERE type = 'correlation_id'),
per AS (SELECT source_type, source_id, count(*) AS n, min(service) AS service, min(value) AS value FROM known GROUP BY ALL),
scoped AS (SELECT source_type, source_id, service, count(*) AS m FROM known GROUP BY ALL),
peer AS (SELECT service, value, count(*) FILTER (m = 1) AS matches, count(*) FILTER (m > 1) AS excluded FROM known JOIN scoped USING (source_type, source_id, service) GROUP BY ALL)
SELECT source_type, source_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status,
  CASE WHEN n IS NULL THEN 'no_eligible_link' WHEN n > 1 THEN 'multiple_eligible_link_keys' ELSE 'one_exact_link_key' END AS reason, CASE WHEN n = 1 THEN 'correlation_id' END AS selected_type, CASE WHEN n = 1 THEN 'namespace:' || per.service END AS selected_scope, CASE WHEN n = 1 THEN per.value END AS selected_value,
  CASE WHEN n = 1 THEN matches ELSE 0 END AS matches, CASE WHEN n = 1 THEN excluded ELSE 0 END AS excluded
FROM evidence LEFT JOIN per USING (source_type, source_id) LEFT JOIN peer ON n = 1 AND peer.service = per.service AND peer.value = per.value"""
)
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return links.resolve(links.exploded(r), r, link_type="correlation_id")


@query(f"WITH {LINKS}, known AS (SELECT DISTINCT source_type, source_id, service, value FROM link WHERE type = 'correlation_id') SELECT source_type, source_id, service AS scope_id, value, CASE WHEN count(*) OVER (PARTITION BY source_type, source_id, service) = 1 THEN 'match' ELSE 'excluded' END AS member FROM known")
def link_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = links.memberships(links.exploded(records(spark, sf_dir)), link_type="correlation_id")
    return out.select("source_type", "source_id", "scope_id", "value", "member")


@query(f"WITH {EVIDENCE} SELECT source_type, source_id, outcome, service FROM evidence WHERE service < 'svc-0005' ORDER BY 1, 3")
def evidence_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).where("service < 'svc-0005'").orderBy("source_type", "outcome").select("source_type", "source_id", "outcome", "service")


@query(f"WITH {EVIDENCE} SELECT count(*) AS rows, 64 AS length, true AS same, true AS differs FROM evidence")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest in one order: the same from another layout, another in another order."""
    e = evidence(spark, sf_dir)
    a = verify.ordered_digest(e, ["source_ts", "source_type", "source_id"], 500)
    b = verify.ordered_digest(e.repartition(3), ["source_ts", "source_type", "source_id"], 500).select(F.col("digest").alias("b"))
    c = verify.ordered_digest(e, ["source_type", "source_id"], 500).select(F.col("digest").alias("c"))
    # each side is one row
    return a.crossJoin(b).crossJoin(c).select("rows", F.length("digest").alias("length"), (F.col("digest") == F.col("b")).alias("same"), (F.col("digest") != F.col("c")).alias("differs"))


@query("SELECT 'unique l_orderkey, l_linenumber' AS rule, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING sum(n) > 0 UNION ALL SELECT 'small', count(*) FROM lineitem WHERE l_quantity >= 45 HAVING count(*) > 0")
def constraint_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.constraint_errors(table(spark, sf_dir, "lineitem"), [["l_orderkey", "l_linenumber"]], ("l_partkey",), {"small": "l_quantity < 45"})


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 4 THEN 'not an object' ELSE 'not JSON' END AS error FROM events")
def json_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects only: repeated names, numbers that aren't finite and broken texts are no JSON."""
    raw = F.element_at(F.array(F.lit('{"a":1}'), F.lit('{"a":1,"a":2}'), F.lit('{"a":NaN}'), F.lit('{"a":'), F.lit("[1]")), (F.col("event_id") % 5 + 1).cast("int"))
    v = F.try_parse_json(raw)
    error = F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", error.alias("error"))


@query(f"WITH {EVIDENCE} SELECT source_type, source_id, CASE WHEN correlation_id <> '' THEN 1 ELSE 0 END AS n_links, nullif(correlation_id, '') AS link_value FROM evidence")
def legacy_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = links.migrated(evidence(spark, sf_dir))
    return m.select("source_type", "source_id", F.size("links").alias("n_links"), F.get("links", F.lit(0))["value"].alias("link_value"))
