"""Queries of publication, extraction, validation, delivery and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, extraction, publish, validate
from ..sources.storage import spread, stored
from ..sources.views import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DOMAIN = "evidence.example"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- audit events with public and private parts --------------------------------------------------------


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as audit records: some denied, some with an array for a body, some without a namespace, some of sensitive resources."""
    n, u = F.col("event_id"), F.col("user_id")
    s = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    name = F.when(u % 7 == 0, s("system:serviceaccount:ns:x", u)).when(u % 7 == 1, s("system:node:", u)).otherwise(s("u", u))
    meta = F.struct(s("d", u % 400).alias("name"), F.create_map(F.lit(f"{DOMAIN}/correlation-id"), s("ord-", u % 400), F.lit("other"), F.lit("x")).alias("annotations"), F.array(F.lit("f")).alias("managedFields"))
    body = F.to_json(F.struct(meta.alias("metadata"), F.struct(F.lit(1).alias("replicas")).alias("spec")))
    body = F.when(n % 4 == 0, None).when(n % 8 == 1, "[1]").otherwise(body)
    space = F.when(n % 10 != 9, F.concat(F.lit(',"namespace":"ns-'), (u % 5).cast("string"), F.lit('"'))).otherwise("")
    raw = F.concat(
        s('{"kind":"Event","apiVersion":"audit.k8s.io/v1","auditID":"a-', n, '","stage":"ResponseComplete","requestReceivedTimestamp":"', at, '","stageTimestamp":"', at, '","verb":"'),
        F.when(u % 50 == 0, "steal").otherwise("create"), s('","user":{"username":"', name, '","groups":["g"]},"sourceIPs":["10.0.0.1"],"objectRef":{"apiGroup":"apps","resource":"'),
        F.when(u % 11 == 0, "secrets").otherwise("deployments"), F.lit('"'), space, s(',"name":"d', u % 400, '"}'),
        F.coalesce(F.concat(F.lit(',"requestObject":'), body), F.lit("")), F.when(n % 4 == 0, ',"responseStatus":{"code":403,"reason":"Forbidden"}}').otherwise(',"responseStatus":{"code":201}}'),
    )
    return spread(table(spark, sf_dir, "events").select("event_id", "user_id", "ts")).select("event_id", raw.alias("raw"))


AUDIT = f"""
a AS (SELECT event_id AS n, user_id AS u, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS t, event_id % 4 = 0 AS denied, event_id % 4 <> 0 AND event_id % 8 = 1 AS listed, event_id % 10 <> 9 AS scoped,
  'ord-' || user_id % 400 AS corr, 'd' || user_id % 400 AS name, 'ns-' || user_id % 5 AS space,
  CASE WHEN user_id % 7 = 0 THEN 'system:serviceaccount:ns:x' || user_id WHEN user_id % 7 = 1 THEN 'system:node:' || user_id ELSE 'u' || user_id END AS actor FROM events),
p AS (SELECT *, scoped AND u % 50 <> 0 AND u % 11 <> 0 AS ok,
  CASE WHEN denied THEN '' WHEN listed THEN '"requestObject":{{}},' ELSE '"requestObject":{{"metadata":{{"annotations":{{"{DOMAIN}/correlation-id":"' || corr || '"}},"name":"' || name || '"}}}},' END AS body,
  concat_ws('|', CASE WHEN u % 50 = 0 THEN '/verb: invalid' END, CASE WHEN NOT scoped THEN '/objectRef/namespace: missing' END, CASE WHEN u % 11 = 0 THEN '/objectRef: sensitive resource' END) AS errors FROM a)"""


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stored, for a filter on what is public would repeat the whole projection
    return stored(publish.published(audit(spark, sf_dir), "raw", publish.audit_spec(DOMAIN), publish.audit_extra(DOMAIN)), "published")


@query(
    f"""WITH {AUDIT} SELECT n AS event_id, array_to_string(list_sort(string_split(errors, '|')), '|') AS errors, CASE WHEN ok THEN '{{"apiVersion":"audit.k8s.io/v1","auditID":"a-' || n || '","kind":"Event","objectRef":{{"apiGroup":"apps","name":"' || name || '","namespace":"' || space || '","resource":"deployments"}},'
  || body || '"requestReceivedTimestamp":"' || t || '","responseStatus":{{"code":' || CASE WHEN denied THEN '403' ELSE '201' END || '}},"stage":"ResponseComplete","stageTimestamp":"' || t || '","user":{{"username":"' || actor || '"}},"verb":"create"}}' END AS public FROM p"""
)
def public_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).select("event_id", F.array_join(F.array_sort("errors"), "|").alias("errors"), "public")


@query(
    f"""WITH {AUDIT}, o AS (SELECT * FROM p WHERE ok), d AS (
  SELECT '/*' AS path, 'not_allowlisted' AS reason FROM o UNION ALL SELECT '/user/*', 'not_allowlisted' FROM o UNION ALL SELECT '/responseStatus/*', 'not_allowlisted' FROM o WHERE denied
  UNION ALL SELECT '/requestObject', 'body_without_allowlisted_metadata' FROM o WHERE listed
  UNION ALL SELECT unnest(['/requestObject/*', '/requestObject/metadata/*', '/requestObject/metadata/annotations/*']), 'not_allowlisted' FROM o WHERE NOT denied AND NOT listed)
SELECT path, reason, count(*) AS dropped FROM d GROUP BY ALL"""
)
def public_audit_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.dropped(_published(spark, sf_dir))


@query(f"WITH {AUDIT} SELECT CASE WHEN NOT scoped THEN 'unscoped' WHEN space = 'ns-1' THEN 'kept' ELSE 'other_namespace' END AS disposition, count(*) AS n FROM a GROUP BY 1")
def scope_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.scoped(audit(spark, sf_dir), "raw", "ns-1").groupBy("disposition").agg(F.count("*").alias("n"))


@query(f"WITH {AUDIT} SELECT n AS event_id FROM a WHERE scoped AND space = 'ns-1'")
def namespace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.in_namespace(audit(spark, sf_dir), "raw", "ns-1").select("event_id")


TARGET = {"api_group": "apps", "resource": "deployments", "namespace": "ns-1", "name": "d1"}


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _published(spark, sf_dir).where("public is not null").select("public")
    return extraction.evidence(extraction.in_namespace(rows, "public", "ns-1"), "public", DOMAIN, "system:node:1", TARGET, "ord-1")


EXTRACTED = (
    AUDIT
    + """,
x AS (SELECT *, NOT denied AND NOT listed AS native, name = 'd1' AS hit FROM p WHERE ok AND space = 'ns-1'),
y AS (SELECT *, hit AND denied AND actor = 'system:node:1' AS explicit FROM x)"""
)


@query(
    f"""WITH {EXTRACTED} SELECT 'a-' || n || ':ResponseComplete' AS source_id, actor, space || '/' || name AS service, CASE WHEN denied THEN '403' ELSE '201' END AS outcome,
  CASE WHEN native THEN corr WHEN explicit THEN 'ord-1' ELSE '' END AS correlation_id, CASE WHEN native THEN 'source_native_object_annotation' WHEN explicit THEN 'adapter_explicit_exact_target' ELSE 'absent' END AS binding FROM y"""
)
def public_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("source_id", "actor", "service", "outcome", "correlation_id", "binding")


@query(
    f"""WITH {EXTRACTED} SELECT count(*) AS records, count(*) FILTER (native AND corr = 'ord-1') AS positive, count(*) FILTER (native AND corr = 'ord-1' AND hit) AS positive_on_target, count(*) FILTER (explicit) AS denials, 0::BIGINT AS denials_with_id,
  count(*) FILTER (name = 'd6') AS negative, count(*) FILTER (name = 'd6' AND native) AS negative_with_id, 0::BIGINT AS conflicts, 0::BIGINT AS repeated FROM y"""
)
def extraction_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.controls(_extracted(spark, sf_dir), "ord-1", "system:node:1", "d6")


@query(f"WITH {EXTRACTED}, l AS (SELECT n, 'operational_correlation' AS type FROM y WHERE native OR explicit UNION ALL SELECT n, 'custom' FROM y WHERE explicit) SELECT type, count(*) AS n FROM l GROUP BY 1")
def audit_profile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark, sf_dir).select(F.explode(extraction.profile_links(DOMAIN, "urn:cluster:c1", "urn:experiment:x1")).alias("l"))
    return rows.groupBy("l.type").agg(F.count("*").alias("n"))


@query(f"WITH {EXTRACTED} SELECT 'a-' || n || ':ResponseComplete' AS source_id, '' AS errors, CASE WHEN actor LIKE 'system:serviceaccount:%' THEN 'service_account' WHEN actor LIKE 'system:%' THEN 'system' ELSE 'unknown' END AS actor_type FROM y")
def audit_profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile records of public audit evidence: all of them valid."""
    made = extraction.profile_records(_extracted(spark, sf_dir), DOMAIN, "urn:cluster:c1", "urn:experiment:x1")
    return validate.validated(made, "record").select("source_id", F.array_join("errors", "|").alias("errors"), F.get_json_object("record", "$.actors.execution_principal.type").alias("actor_type"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    note = lambda v: F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), v)
    one = lambda v, name: F.struct(F.struct(name.alias("name"), note(v).alias("annotations")).alias("metadata"))
    same = F.concat(F.lit("n"), k)
    raw = F.to_json(F.struct(F.struct(same.alias("name")).alias("objectRef"), one(F.lit("2"), same).alias("requestObject"), F.when(k % 2 == 0, one(F.when(k % 6 == 0, "3").otherwise("2"), F.when(k % 10 == 0, "other").otherwise(same))).alias("responseObject")))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


@query("SELECT p_partkey, 'n' || p_partkey AS meta_name, 2 AS annotations, concat_ws('|', CASE WHEN p_partkey % 6 = 0 THEN 'annotations differ' END, CASE WHEN p_partkey % 10 = 0 THEN 'name differs' END) AS conflict FROM part")
def metadata_unification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.unified_metadata(_metadata(spark, sf_dir), "raw")
    return rows.select("p_partkey", "meta_name", F.size("annotations").alias("annotations"), F.array_join("conflict", "|").alias("conflict"))


# --- records with known defects ------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile records; the last digit of the key says what is wrong with odd ones."""
    k = F.col("p_partkey")
    d = k % 10
    link = lambda x: f'{{"type":"ticket_id","value":"{x}","scope":{{"type":"system","id":"s"}},"evidence_method":"explicit"}}'
    links = F.when(d == 3, f"[{link('a')},{link('b')},{link('a')}]").when(d == 9, '[{"type":"artifact_digest","value":"sha256:zz","scope":{"type":"system","id":"s"},"evidence_method":"inferred"}]').otherwise(f"[{link('a')}]")
    raw = F.concat(
        F.lit('{"profile":"evidence.profile/1.3","source_type":"'), F.when(d == 1, "Bad Type").otherwise("a.b"), F.lit('","source_id":"'), k.cast("string"), F.lit('","source_ts":"2026-01-01T00:00:00Z","observed_ts":"'), F.when(d == 5, "yesterday").otherwise("2026-01-01T00:00:01.5+02:00"),
        F.lit('","actors":{"initiator":{"id":"me","type":"human","scope":{"type":"account","id":"x"}}},"service":{"id":"svc","type":"application","scope":{"type":"'), F.when(d == 7, "planet").otherwise("cluster"), F.lit('","id":"c"}},"intent":"i","policy":"p","action":"a","outcome":"'), F.when(d == 5, "").otherwise("ok"),
        F.lit('","source_pointer":"'), F.when(d == 1, "no uri").otherwise("urn:x:1"), F.lit('","links":'), links, F.when(d == 7, ',"extra":1').otherwise(""), F.lit(',"extensions":{"org.x/y":{"z":[1,null]}}}'),
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", raw.alias("raw"))


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN '$.source_pointer: no absolute URI|$.source_type: no lower-case namespaced type' WHEN 3 THEN '$.links[2]: repeats links[0]' WHEN 5 THEN '$.observed_ts: no RFC 3339 time|$.outcome: empty'
  WHEN 7 THEN '$.service.scope.type: unsupported|$: unknown extra' WHEN 9 THEN '$.links[0].confidence: needs a number in (0, 1]|$.links[0].value: no digest' ELSE '' END AS errors FROM part""")
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validated(_records(spark, sf_dir), "raw").select("p_partkey", F.array_join(F.array_sort("errors"), "|").alias("errors"))


@query("SELECT position, first_seen, l_returnflag, l_partkey FROM (SELECT l_orderkey * 8 + l_linenumber AS position, l_returnflag, l_partkey, min(l_orderkey * 8 + l_linenumber) OVER (PARTITION BY l_returnflag, l_partkey) AS first_seen FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_partkey FROM lineitem)) WHERE position > first_seen")
def repeated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), "l_returnflag", "l_partkey").distinct()
    return validate.repeated_sources(rows, "position", ("l_returnflag", "l_partkey"))


@query(r"SELECT page_id, coalesce(regexp_full_match(u, '[A-Za-z][A-Za-z0-9+.-]*:[^\s]+') AND length(u) <= 4096, false) AS valid FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || ' x' ELSE url END AS u FROM pages)")
def uri_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", validate.valid_uri(F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(" x"))).otherwise(F.col("url"))).alias("valid"))


# --- delivery runs, jobs and artifacts -----------------------------------------------------------------

RUN_SHA = "substr(sha256('c' || o_orderkey), 1, 40)"


def _delivery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    actor = F.struct(F.when(k % 9 != 0, F.concat(F.lit("dev"), k % 20)).alias("login"), (k % 20 + 1).alias("id"), F.when(k % 3 == 0, "Bot").when(k % 3 == 1, "User").otherwise("Odd").alias("type"))
    run = F.struct(k.alias("id"), F.lit(1).alias("run_attempt"), F.lit("build").alias("name"), F.substring(F.sha2(F.concat(F.lit("c"), k), 256), 1, 40).alias("head_sha"), F.lit("completed").alias("status"), F.lit("success").alias("conclusion"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.lit("2026-01-01T00:00:01Z").alias("updated_at"), F.concat(F.lit("https://Git.example/r/"), k, F.lit("?token=x")).alias("html_url"), actor.alias("actor"), F.struct(F.lit(7).alias("id"), F.lit("o/r").alias("full_name")).alias("repository"))
    j = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("run_id"), F.when(F.col("l_quantity") > 49, 2).otherwise(1).alias("run_attempt"), F.lit("").alias("name"), F.col("l_linestatus").alias("status"), F.array(F.lit("linux")).alias("labels"), F.array(F.struct(F.lit(1).alias("number"), F.lit("").alias("name"))).alias("steps"))
    a = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("img").alias("name"), (F.col("l_linestatus") == "F").alias("expired"), F.struct(F.col("l_orderkey").alias("id")).alias("workflow_run"))
    raw = lambda df, x: df.select(F.to_json(x).alias("raw"))
    first = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_linestatus").alias("l_linestatus"), F.max("l_returnflag").alias("l_returnflag"))
    return raw(o, run), raw(first, j), raw(first.where("l_returnflag = 'R'"), a)


LINES = "f AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_linestatus) AS s, max(l_returnflag) AS r FROM lineitem GROUP BY ALL)"


@query(f"WITH {LINES} SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN q > 49 THEN 2 ELSE 1 END AS run_attempt, 'unnamed-job' AS name, 'unknown-workflow' AS workflow_name, s AS status, 'linux' AS labels, 'unnamed-step:unknown' AS steps FROM f")
def minimal_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, jobs, _ = _delivery(spark, sf_dir)
    m = delivery.parsed(jobs, "raw", delivery.JOB).select(delivery.minimal_job(F.col("x")).alias("j")).select("j.*")
    return m.select("id", "run_attempt", "name", "workflow_name", "status", F.array_join("labels", ",").alias("labels"), F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["name"], s["status"])), ",").alias("steps"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _delivery(spark, sf_dir)
    return delivery.snapshots(*[delivery.parsed(df, "raw", kind) for df, kind in zip(parts, (delivery.RUN, delivery.JOB, delivery.ARTIFACT), strict=True)])


@query(
    f"""WITH {LINES}, j AS (SELECT l_orderkey AS run_id, count(*) AS jobs, count(*) FILTER (r = 'R') AS artifacts, bool_or(q > 49) AS other FROM f GROUP BY 1)
SELECT o_orderkey AS run_id, coalesce(jobs, 0) AS jobs, coalesce(artifacts, 0) AS artifacts, concat_ws('|', CASE WHEN o_orderkey = 0 THEN 'identity missing' END, CASE WHEN other THEN 'job of another attempt' END) AS errors, 'delivery-7-' || o_orderkey || '-1' AS correlation_id, 'https://git.example/r/' || o_orderkey AS url, '' AS violations
FROM orders LEFT JOIN j ON run_id = o_orderkey"""
)
def delivery_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lambda p: F.get_json_object("snapshot", p)
    size = lambda p: F.size(F.from_json(got(p), "array<string>")).cast("long")
    return _snapshots(spark, sf_dir).select("run_id", size("$.jobs").alias("jobs"), size("$.artifacts").alias("artifacts"), F.array_join("errors", "|").alias("errors"), got("$.projection.correlation_id").alias("correlation_id"), got("$.run.html_url").alias("url"), F.array_join(delivery.snapshot_errors(F.col("snapshot")), "|").alias("violations"))


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 50 = 7 THEN 'changed' ELSE 'missing' END AS status FROM orders WHERE o_orderkey % 50 IN (7, 9)")
def bundle_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bundles, some tampered with and some lost, against what their sources give anew."""
    made = _snapshots(spark, sf_dir)
    held = made.where("run_id % 50 <> 9").withColumn("snapshot", F.when(F.col("run_id") % 50 == 7, F.concat("snapshot", F.lit(" "))).otherwise(F.col("snapshot")))
    return delivery.rebuilt(held, made, "run_id", "snapshot")


@query(f"WITH {LINES} SELECT l_orderkey * 10 + l_linenumber AS id FROM f WHERE q > 49 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 40 <> 3)")
def foreign_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, jobs, _ = _delivery(spark, sf_dir)
    j = delivery.parsed(jobs, "raw", delivery.JOB).select("x.id", F.col("x.run_id").alias("run"), F.col("x.run_attempt").alias("attempt"))
    r = delivery.parsed(runs, "raw", delivery.RUN).select(F.col("x.id").alias("run"), F.col("x.run_attempt").alias("attempt")).where("run % 40 <> 3")
    return delivery.foreign(j, r, "run", ["attempt"]).select("id")


@query(f"""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 9 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'automation' WHEN 1 THEN 'human' ELSE 'unknown' END END AS actor_type, 'operational_correlation:c-' || o_orderkey || ',workflow_run:github://repositories/7/actions/runs/' || o_orderkey || '/attempts/1,vcs_revision:' || {RUN_SHA} AS links,
  '{{"metadata":{{"annotations":{{"{DOMAIN}/correlation-id":"c-' || o_orderkey || '","{DOMAIN}/github-commit-sha":"' || {RUN_SHA} || '","{DOMAIN}/github-repository":"o/r","{DOMAIN}/github-repository-id":"7","{DOMAIN}/github-run-attempt":"1","{DOMAIN}/github-run-id":"' || o_orderkey || '","{DOMAIN}/github-source-url":"https://git.example/r/' || o_orderkey || '","{DOMAIN}/github-workflow":"build","{DOMAIN}/source-plane":"github-actions"}}}}}}' AS patch FROM orders""")
def delivery_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, _, _ = _delivery(spark, sf_dir)
    r = delivery.parsed(runs, "raw", delivery.RUN).select(delivery.minimal_run(F.col("x")).alias("run"), F.col("x.repository").alias("repository"))
    corr = F.concat(F.lit("c-"), F.col("run.id"))
    links = delivery.links(F.col("run"), F.col("repository"), corr, "urn:experiment:x1", "run")
    return r.select(F.col("run.id").alias("run_id"), delivery.actor_type(F.col("run.actor"))["type"].alias("actor_type"), F.array_join(F.transform(links, lambda x: F.concat_ws(":", x["type"], x["value"])), ",").alias("links"), delivery.object_patch(F.col("run"), F.col("repository"), corr, DOMAIN).alias("patch"))


def _public_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    t = F.lit("2026-01-01T00:00:00Z")
    sha = F.substring(F.sha2(F.concat(F.lit("c"), k), 256), 1, 40)
    run = F.struct(k.alias("id"), F.struct(F.lit(7).alias("id"), F.when(k % 13 == 0, "../r").otherwise("o/r").alias("full_name"), (k % 5 == 0).alias("private")).alias("repository"), F.lit(1).alias("run_attempt"), sha.alias("head_sha"), t.alias("created_at"), t.alias("updated_at"), F.struct(F.lit(1).alias("id"), F.lit("dev[bot]").alias("login")).alias("actor"), F.lit("main").alias("head_branch"))
    f = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    job = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("run_id"), F.when(F.col("q") > 49, 2).otherwise(1).alias("run_attempt"), F.lit("n").alias("name"), F.lit("r").alias("runner"))
    art = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.struct(F.col("l_orderkey").alias("id"), F.when(F.col("q") < 2, 8).otherwise(7).alias("repository_id")).alias("workflow_run"), F.lit(False).alias("expired"))
    raw = lambda df, x: df.select(F.to_json(x).alias("raw"))
    return raw(o, run), raw(f, job), raw(f.where("l_linenumber = 1"), art)


BUNDLES = """
f AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
ok AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0),
j AS (SELECT l_orderkey, count(*) AS jobs, bool_or(q > 49) AS xj, count(*) FILTER (l_linenumber = 1) AS arts, coalesce(bool_or(q < 2) FILTER (l_linenumber = 1), false) AS xa FROM f GROUP BY 1)"""


@query(f"WITH {BUNDLES} SELECT o_orderkey AS run_id, coalesce(jobs, 0) AS jobs, coalesce(arts, 0) AS artifacts, concat_ws('|', CASE WHEN xj THEN 'job outside the run''s attempt' END, CASE WHEN xa THEN 'artifact outside the run''s identity' END) AS errors FROM ok LEFT JOIN j ON l_orderkey = o_orderkey")
def public_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = publish.bundles(*_public_runs(spark, sf_dir))
    return rows.withColumn("errors", F.array_join("errors", "|"))


@query(f"WITH {BUNDLES} SELECT '/run/*' AS path, 'not_allowlisted' AS reason, (SELECT count(*) FROM ok) AS dropped UNION ALL SELECT '/jobs/*/*', 'not_allowlisted', 2 * (SELECT count(*) FROM f WHERE l_orderkey > 0)")
def public_bundle_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.bundles(*_public_runs(spark, sf_dir))[1]


@query("""SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey = 0 THEN '/id: invalid' END, CASE WHEN o_orderkey % 13 = 0 THEN '/repository/full_name: invalid' END, CASE WHEN o_orderkey % 5 = 0 THEN '/repository: private' END) AS errors, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0 THEN 'https://github.com/o/r/actions/runs/' || o_orderkey END AS html_url FROM orders""")
def public_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = publish.published_runs(_public_runs(spark, sf_dir)[0], "raw")
    return rows.select(F.get_json_object("raw", "$.id").cast("long").alias("o_orderkey"), F.array_join("errors", "|").alias("errors"), "html_url")


@query("SELECT p_partkey, p_partkey % 3 = 0 AS same FROM part")
def digest_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = F.concat(F.lit("sha256:"), F.sha2(k.cast("string"), 256))
    other = F.when(k % 3 == 0, d).when(k % 3 == 1, F.upper(d)).otherwise(F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256)))
    return table(spark, sf_dir, "part").select("p_partkey", publish.same_digest(d, other).alias("same"))


# --- report across planes ------------------------------------------------------------------------------


def _planes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    digest = lambda k: F.concat(F.lit("sha256:"), F.sha2(k.cast("string"), 256))
    corr = lambda k: F.concat(F.lit("ord-"), k.cast("string"))
    n = F.col("o_orderkey") % 700
    d = table(spark, sf_dir, "orders").select(corr(n).alias("correlation_id"), F.lit("reg/app").alias("subject_uri"), digest(n).alias("subject_digest"))
    u = F.col("user_id") % 400
    c = table(spark, sf_dir, "events").select(corr(u).alias("correlation_id"), F.when(F.col("event_id") % 3 == 0, "other.log").otherwise("kubernetes.audit").alias("source_type"), F.concat(F.lit("a"), u % 3).alias("actor"), F.when(F.col("event_id") % 4 == 0, "403:Forbidden").otherwise("201").alias("outcome"))
    k = F.col("p_partkey") % 500
    o = table(spark, sf_dir, "part").select(corr(k).alias("correlation_id"), F.lit("reg/app").alias("subject_uri"), F.when(F.col("p_partkey") % 3 == 0, digest(k)).otherwise("sha256:0").alias("subject_digest"), F.array(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("reg/app@"), digest(k))).otherwise("reg/old")).alias("images"))
    s = F.col("c_custkey") % 300
    pods = table(spark, sf_dir, "customer").select(corr(s).alias("correlation_id"), F.when(F.col("c_custkey") % 50 != 1, corr(s)).alias("annotated"), F.array(F.lit("reg/app:1")).alias("images"), F.array(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("docker://reg/app@"), digest(s))).otherwise("docker://x")).alias("image_ids"))
    return d, c, o, pods


PLANES = """
d AS (SELECT 'ord-' || o_orderkey % 700 AS k, count(*) AS delivery_rows FROM orders GROUP BY 1),
c AS (SELECT 'ord-' || user_id % 400 AS k, count(*) AS cluster_rows, count(*) FILTER (event_id % 4 = 0) AS denied_rows, array_to_string(list_sort(list(DISTINCT 'a' || (user_id % 400) % 3)), ',') AS principals FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
o AS (SELECT 'ord-' || p_partkey % 500 AS k, count(*) AS objects, bool_or(p_partkey % 3 = 0) AS subject, bool_or(p_partkey % 2 = 0) AS image FROM part GROUP BY 1)"""


@query(
    f"""WITH {PLANES} SELECT k AS correlation_id, delivery_rows, coalesce(cluster_rows, 0) AS cluster_rows, coalesce(denied_rows, 0) AS denied_rows, coalesce(principals, '') AS principals, coalesce(subject, false) AS subject_match, coalesce(image, false) AS image_match,
  CASE WHEN coalesce(cluster_rows, objects) IS NULL THEN 'no_matching_cluster_evidence_observed' WHEN subject AND image THEN 'observed_cross_plane_link_with_subject_digest' ELSE 'observed_cross_plane_link' END AS status FROM d LEFT JOIN c USING (k) LEFT JOIN o USING (k)"""
)
def join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c, o, _ = _planes(spark, sf_dir)
    return delivery.report(d, c, o)


@query(
    """WITH p AS (SELECT 'ord-' || c_custkey % 300 AS correlation_id, count(*) AS pods, bool_and(c_custkey % 50 <> 1) AS all_annotated, 'reg/app:1' AS images, false AS spec_match, bool_or(c_custkey % 4 = 0) AS runtime_match FROM customer GROUP BY 1)
SELECT p.* FROM p WHERE correlation_id IN (SELECT 'ord-' || o_orderkey % 700 FROM orders)"""
)
def running_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _, _, pods = _planes(spark, sf_dir)
    return delivery.running(pods, d)
