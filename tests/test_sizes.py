"""Queries against their SQL on rows that the smallest tables lack."""

from __future__ import annotations

import json

import __spark_entry__
import duckdb
import pytest
from evidentia.operators import delivery, publish, validate
from pyspark.sql import functions as F


def both(spark, name, tables):
    """Rows of the query and of its SQL over one folder of tables."""
    con = duckdb.connect()
    for t in tables.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tables))
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("null", [False, True])
def test_a_full_queue_counts_events_and_not_their_repetitions(spark, tmp_path, null):
    n = F.col("id")
    line = spark.range(21_000).select(n.alias("l_orderkey"), F.when(n % 7 > 0 if null else F.lit(True), 1).cast("int").alias("l_linenumber"), n.alias("l_partkey"), (n % 10).alias("l_suppkey"), F.lit(1.0).alias("l_quantity"), F.date_add(F.lit("1992-01-01").cast("date"), (n / 10).cast("int")).alias("l_shipdate"))
    again = line.where("l_orderkey % 5 = 0").withColumn("l_partkey", F.col("l_partkey") + F.col("l_orderkey") % 2).withColumn("l_shipdate", F.date_add("l_shipdate", 1000))
    line.unionByName(again).write.parquet(str(tmp_path / "lineitem.parquet"))
    got, want = both(spark, "bounded_queue", tmp_path)
    assert got == want == [(20_000, 1_000)]


@pytest.mark.parametrize("name", ["record_violations", "audit_profile_records", "public_audit", "delivery_snapshots"])
def test_costly_records_are_dealt_over_the_cores(spark, small, name):
    assert __spark_entry__.queries()[name](spark, small).rdd.getNumPartitions() >= 4


def test_a_member_is_looked_at_once_however_many_rules_ask(monkeypatch, spark):
    asked = []
    monkeypatch.setattr(F, "schema_of_variant", lambda c, own=F.schema_of_variant: asked.append(c) or own(c))
    df = spark.createDataFrame([("{}",)], "raw string")
    validate.validated(df, "raw")
    publish.published(df, "raw", publish.audit_spec("e.example"), publish.audit_extra("e.example"))
    delivery.snapshot_errors(F.col("raw"))
    assert len(asked) < 250


def test_snapshot_rules_on_odd_snapshots(spark):
    run = dict.fromkeys(delivery.FIELDS["run"]) | {"id": 5, "run_attempt": 1, "html_url": "https://a.b/c"}
    job = dict.fromkeys(delivery.FIELDS["jobs"]) | {"id": 1, "run_id": 5}
    good = {"artifacts": [], "jobs": [job], "projection": {"correlation_id": "d-7-5-1"}, "repository": {"id": 7}, "run": run}
    cases = [(good, []), (good | {"x": 1}, ["fields"]), (good | {"jobs": [job | {"run_id": 6}]}, ["jobs: of another run"]), (good | {"jobs": None}, ["jobs: fields", "jobs: of another run", "jobs: URL"]), (good | {"run": run | {"created_at": "now"}}, ["run: created_at"]), (good | {"repository": {"id": 8}}, ["correlation_id"])]
    df = spark.createDataFrame([(json.dumps(c),) for c, _ in cases] + [("{",)], "raw string")
    got = {r.raw: r.e for r in df.select("raw", delivery.snapshot_errors(F.col("raw")).alias("e")).collect()}
    assert got == {json.dumps(c): e for c, e in cases} | {"{": ["not JSON"]}


def test_a_rule_of_records_is_no_expression(monkeypatch, spark):
    # as expressions, rules took a millisecond a record and 20 s to plan
    asked = []
    for name in ("when", "schema_of_variant"):
        monkeypatch.setattr(F, name, lambda *a, own=getattr(F, name): asked.append(a) or own(*a))
    validate.validated(spark.createDataFrame([("{}",)], "raw string"), "raw")
    assert len(asked) < 10


SCOPE = {"type": "system", "id": "s"}
LINK = {"type": "ticket_id", "value": "a", "scope": SCOPE, "evidence_method": "explicit"}
RECORD = {"profile": "evidence.profile/1.3", "source_type": "a.b", "source_id": "1", "source_ts": "2026-01-01T00:00:00Z", "observed_ts": "2026-01-01T00:00:01.5+02:00", "actors": {}, "service": {"id": "v", "type": "application", "scope": SCOPE}, "intent": "i", "policy": "p", "action": "a", "outcome": "o", "source_pointer": "urn:x:1", "links": []}
DIGEST = {"algorithm": "sha256", "value": "a" * 64, "representation": "raw_bytes"}
ODD_RECORDS = [
    ({}, []),
    ({"source_digest": DIGEST, "actors": {"attester": {"id": "x", "type": "human", "scope": SCOPE, "display_name": "n"}}, "extensions": {"a.b/c": None}}, []),
    ({"source_ts": "2026-02-29T00:00:00Z", "observed_ts": "0000-02-29T23:59:59.1234567890-18:00"}, ["$.source_ts: no RFC 3339 time"]),
    ({"source_ts": "2026-01-01T24:00:00Z", "observed_ts": "2026-01-01T00:00:00+18:01"}, ["$.source_ts: no RFC 3339 time", "$.observed_ts: no RFC 3339 time"]),
    ({"intent": None, "policy": "", "action": "x" * 2049, "outcome": "a\x7f"}, ["$.intent: not text", "$.policy: empty", "$.action: over 2048 characters", "$.outcome: control character"]),
    ({"intent": "\U0001f600" * 2048, "source_pointer": "urn:" + "x" * 4093}, ["$.source_pointer: over 4096 characters"]),
    ({"actors": None, "service": [], "links": None, "extensions": 1, "source_digest": None}, ["$.actors: not an object", "$.service: not an object", "$.source_digest: not an object", "$.extensions: not an object", "$.links: not an array"]),
    ({"actors": {"z": 1, "a,b": 1, "initiator": {"type": ["human"]}}}, ["$.actors: unknown a,b,z", *[f"$.actors.initiator: {n} missing" for n in ("id", "scope")], "$.actors.initiator.id: not text", "$.actors.initiator.type: unsupported", "$.actors.initiator.scope: not an object"]),
    ({"source_digest": DIGEST | {"algorithm": "sha512", "representation": "x"}}, ["$.source_digest.value: not hexadecimal of its length", "$.source_digest.representation: unsupported", "$.source_digest.canonicalization: missing"]),
    ({"links": [1, LINK, None, LINK | {"confidence": 1}]}, ["$.links[0]: not an object", "$.links[2]: not an object", "$.links[3].confidence: for inferred links only", "$.links[2]: repeats links[0]", "$.links[3]: repeats links[1]"]),
    ({"links": [LINK | {"type": "custom"}, LINK | {"evidence_method": "inferred", "confidence": True}, LINK | {"evidence_method": "digest_match", "value": "b"}]}, ["$.links[0].custom_type: needs a namespaced type", "$.links[1].confidence: needs a number in (0, 1]", "$.links[2]: digest_match is for artifact digests"]),
]
RAW = [(None, "$: not JSON"), ("", "$: not JSON"), ("{", "$: not JSON"), ('{"a":1,"a":1}', "$: not JSON"), ('{"a":NaN}', "$: not JSON"), ("1x", "$: not JSON"), ("nullx", "$: not JSON"), ('{"a":' + "[" * 1000 + "]" * 1000 + "}", "$: not JSON"), ("[" * 200_000, "$: not JSON"), ("null", "$: not an object"), ("1 x", "$: not an object"), ("[{}]", "$: not an object")]


def test_rules_on_odd_records(spark):
    cases = [(json.dumps(RECORD | x), e) for x, e in ODD_RECORDS] + [(x, [e]) for x, e in RAW]
    cases += [(" " + json.dumps(RECORD) + " x", []), (json.dumps(RECORD | {"n": 0}).replace(": 0", ": " + "1" * 5000), ["$: unknown n"]), (json.dumps(RECORD)[:-1] + r', "\ud800": 1}', ["$: unknown ?"])]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, raw string")
    got = {r.i: r.errors for r in validate.validated(df, "raw").collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_a_record_that_is_no_utf8_fails_no_job(spark):
    df = spark.createDataFrame([(bytearray(json.dumps(RECORD).encode().replace(b'"i"', b'"\xff"')),), (bytearray(b"\xff"),)], "raw binary").select(F.col("raw").cast("string"))
    assert sorted(r.errors for r in validate.validated(df, "raw").collect()) == [[], ["$: not JSON"]]
