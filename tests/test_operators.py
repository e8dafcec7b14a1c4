"""Ledger, links, adapters, privacy, readers, sinks, layouts and streams on small cases."""

from __future__ import annotations

import json

import pytest
from evidentia.operators import crossplane, faults, ledger, links, normalize, privacy, verify
from evidentia.sources import readers, sinks, synthetic
from evidentia.streaming import live
from pyspark.sql import functions as F

ARRIVAL = "tenant_id string, source_id string, event_id string, sequence long, fingerprint string, arrival string"


def test_decisions_follow_arrival(spark):
    rows = [("t", "s", "a", 1, "x", "1"), ("t", "s", "a", 1, "x", "2"), ("t", "s", "a", 1, "y", "3"), ("t", "s", "b", 1, "z", "4"), ("t", "s", "b", 2, "z", "5"), ("t", "s", "b", 2, "z", "6"), ("t", "r", "a", 1, "x", "7")]
    got = {r.arrival: r.decision for r in ledger.decide(spark.createDataFrame(rows, ARRIVAL)).collect()}
    assert got == {"1": "queued", "2": "duplicate", "3": "event_id_conflict", "4": "sequence_conflict", "5": "queued", "6": "duplicate", "7": "queued"}
    old = spark.createDataFrame([("t", "s", "a", 1, "x", "pruned"), ("t", "s", "c", 9, "w", "stored")], "tenant_id string, source_id string, event_id string, sequence long, fingerprint string, state string")
    more = spark.createDataFrame([("t", "s", "a", 1, "x", "1"), ("t", "s", "c", 9, "v", "2"), ("t", "s", "d", 9, "w", "3"), ("t", "s", "e", 4, "w", "4"), ("t", "s", "f", 5, "w", "5")], ARRIVAL)
    got = {r.arrival: r.decision for r in ledger.decide(more, old, max_pending=1).collect()}
    assert got == {"1": "pruned", "2": "event_id_conflict", "3": "sequence_conflict", "4": "queued", "5": "queue_full"}


def test_completeness_and_gaps(spark):
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, m long")
    stored = spark.createDataFrame([("a", 1), ("b", 1), ("c", 7)], "s string, m long")
    got = {r.s: (r.status, r.missing_count) for r in ledger.completeness(expected, stored, ["s"], "m").collect()}
    assert got == {"a": ("INCOMPLETE", 1), "b": ("COMPLETE", 0), "c": ("UNKNOWN", 0)}
    seq = spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("a", 6), ("b", 3)], "s string, sequence long")
    assert [tuple(r) for r in ledger.gaps(seq, ["s"]).collect()] == [("a", 2, 4)]


def test_sealed_bodies_open_under_their_own_identity(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([("a", "body")], "id string, b string").select("id", ledger.seal(F.col("b"), key, F.col("id")).alias("c"))
    row = df.select(ledger.unseal(F.col("c"), key, F.col("id")).cast("string").alias("own"), ledger.unseal(F.col("c"), key, F.lit("x")).alias("other")).first()
    assert row.own == "body" and row.other is None


def record(sid, *found):
    return ("t", sid, [{"type": k, "custom_type": None, "value": v, "scope": {"type": "namespace", "id": s}, "evidence_method": m, "confidence": c} for k, v, s, m, c in found])


def test_resolution_abstains(spark):
    native = lambda v, s="n": ("correlation_id", v, s, "source_native", None)
    rows = [record("one", native("a")), record("peer", native("a")), record("bridge", native("a"), native("b")), record("none"), record("far", native("a", "m")), record("guess", ("correlation_id", "a", "n", "inferred", 0.9)), record("wide", native("a"), native("z", "m"))]
    df = spark.createDataFrame(rows, f"source_type string, source_id string, links {links.LINK}")
    ex = links.exploded(df)
    got = {r.source_id: (r.status, r.matches, r.excluded) for r in links.resolve(ex, df, link_type="correlation_id").collect()}
    # a peer with a second key in another scope still matches in the seed's
    assert got["one"] == ("resolved", 3, 1) and got["far"] == ("resolved", 1, 0)
    assert got["bridge"][0] == "ambiguous" and got["wide"][0] == "ambiguous" and got["none"][0] == "missing" and got["guess"][0] == "missing"
    sure = {r.source_id: r.status for r in links.resolve(ex, df, link_type="correlation_id", allow_inferred=True, minimum=0.9).collect()}
    assert sure["guess"] == "resolved"


def test_audit_fallbacks_and_binding(spark):
    base = {"auditID": "1", "stage": "S", "verb": "get", "user": {"username": "u"}, "objectRef": {"apiGroup": "apps", "resource": "deployments", "name": "d"}, "requestURI": "/apis/x/namespaces/ns/deployments"}
    made = [base | {"responseStatus": {"code": 200}, "requestObject": {"metadata": {"annotations": {"correlation-id": "c1"}}}}, base | {"auditID": "2", "responseStatus": {"code": 403, "reason": "Forbidden"}, "impersonatedUser": {"username": "i"}}, {"auditID": "", "verb": ""}]
    df = spark.createDataFrame([(json.dumps(m),) for m in made], "raw string")
    rows = {r.source_id: r for r in crossplane.audit_evidence(df).collect()}
    assert rows["1:S"].correlation_id == "c1" and rows["1:S"].service == "ns/d" and rows["1:S"].outcome == "200"
    assert rows["2:S"].correlation_id == "k8s://ns/deployments/d" and rows["2:S"].actor == "i" and rows["2:S"].outcome == "403:Forbidden"
    assert sum(r.actor == "unknown" and r.outcome == "unknown" and r.action == "unknown" for r in rows.values()) == 1
    target = spark.createDataFrame([("apps", "deployments", "ns", "d", "c1")], "api_group string, resource string, namespace string, name string, correlation_id string")
    got = {r.source_id: (r.binding, r.bound_correlation) for r in crossplane.bound(crossplane.audit_evidence(df), target).collect()}
    assert got["1:S"] == ("source_native_object_annotation", "c1") and got["2:S"] == ("adapter_explicit_exact_target", "c1")


def test_delivery_evidence(spark):
    run = {"id": 5, "run_attempt": 1, "path": "w.yml", "status": "completed", "conclusion": "success", "created_at": "2026-01-01T00:00:00Z", "html_url": "https://Host/x?token=1", "actor": {"login": "me"}, "repository": {"id": 9}}
    job = {"id": 7, "run_id": 5, "status": "queued", "created_at": "2026-01-01T00:00:01Z"}
    art = {"id": 8, "name": "a", "expired": True, "workflow_run": {"id": 5}}
    parsed = [spark.createDataFrame([(json.dumps(x),)], "raw string").select(F.from_json("raw", kind).alias("r")).select("r.*") for x, kind in ((run, crossplane.RUN), (job, crossplane.JOB), (art, crossplane.ARTIFACT))]
    got = {r.source_type.rsplit(".", 1)[1]: r for r in crossplane.delivery_evidence(*parsed, service="svc", captured_at="2026-01-02T00:00:00Z").collect()}
    assert got["run"].source_pointer == "https://host/x" and got["run"].outcome == "conclusion:success" and got["run"].policy == "github-actions:w.yml"
    assert got["job"].outcome == "status:queued" and got["artifact"].outcome == "expired"
    assert len({r.correlation_id for r in got.values()}) == 1


def test_privacy(spark):
    df = spark.createDataFrame([(1, '{"a":"1","b":"x","c":"2"}'), (2, "{}")], "id long, raw string")
    rule = {"a": "[0-9]", "b": "[0-9]"}
    assert [r.p for r in df.select(privacy.allowed_json(F.col("raw"), rule).alias("p")).collect()] == ['{"a":"1"}', "{}"]
    assert {(r.path, r.reason, r.dropped) for r in privacy.drops(df, "raw", rule).collect()} == {("b", "invalid_value", 1), ("*", "not_allowlisted", 1)}
    deep = spark.createDataFrame([(1, '{"x":[{"token":"t","data":1,"y":"Bearer abc"}]}'), (2, "no")], "id long, raw string")
    assert [r.redacted for r in privacy.redacted_json(deep, "raw").orderBy("id").collect()] == ['{"x":[{"data":1,"token":"<redacted-sensitive-value>","y":"Bearer abc"}]}', None]
    assert {r.path for r in privacy.unsafe_paths(deep, "raw", ("id",)).collect()} == {".x[0].token", ".x[0].y"}


def test_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n[1]\n{"a":1,"a":2}\nx\n')
    assert sorted(str(r.error) for r in readers.json_lines(spark, str(tmp_path / "l.jsonl")).collect()) == ["None", "not JSON", "not JSON", "not an object"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"records":[{"b":1,"a":2},{}]}')
    (tmp_path / "r/b.json").write_text('{"x":1} {"x":2}')
    assert sorted(r.record for r in readers.json_records(spark, str(tmp_path / "r")).collect()) == ['{"a":2,"b":1}', '{"x":1}', '{"x":2}', "{}"]
    (tmp_path / "c.csv").write_text("b,a\n1,2\n")
    assert readers.csv(spark, str(tmp_path / "c.csv"), ["a", "b"]).first() == ("2", "1")
    with pytest.raises(readers.ContractError):
        readers.csv(spark, str(tmp_path / "c.csv"), ["a", "b"], ordered=True)
    (tmp_path / "m").write_text("0" * 64 + "  a/b\n" + "1" * 64 + "  ../c\nbad\n")
    assert [r.error for r in readers.manifest(spark, str(tmp_path / "m")).orderBy(F.desc("path")).collect()] == [None, "unsafe path", "malformed"]
    export = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1", "body": {"stringValue": "x"}}, {"timeUnixNano": "2", "body": {"intValue": "5"}}]}]}]}
    logs = readers.log_records(spark.createDataFrame([(json.dumps(export),)], "raw string"), "raw")
    assert [(r.time, r.body) for r in logs.collect()] == [("1", "x"), ("2", "5")]


def test_sinks_and_layouts(spark, tmp_path):
    df = normalize.unified(synthetic.fragmented(synthetic.planes(spark, 600, 20, 9137)))
    table = sinks.AppendOnly(spark, str(tmp_path / "t"), ("source_type", "source_id"))
    assert table.append(df) == 600
    with pytest.raises(readers.ContractError):
        table.append(df.limit(1))
    with pytest.raises(readers.ContractError):
        table.overwrite(df)
    sinks.by_plane(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 600
    sinks.json_lines(df, str(tmp_path / "j"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.json_lines(df, str(tmp_path / "j"))
    sinks.checksums(spark, str(tmp_path / "p"), str(tmp_path / "sums"))
    sums = readers.manifest(spark, str(tmp_path / "sums"))
    assert sums.count() > 0 and sums.where("error is not null").count() == 0
    want = verify.table_digest(df).first()
    for layout in verify.LAYOUTS:
        path = str(tmp_path / layout)
        verify.write_layout(df, path, layout, files=2)
        back = spark.read.parquet(path)
        assert verify.table_digest(back).first() == want
        assert verify.plan_facts(back.where("service = 'svc-0001'"))["pushed"]


def test_streams_equal_batches(spark, tmp_path):
    obs = synthetic.observations(spark, 24, 4, (9238,))
    obs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.completions(stream).writeStream.format("memory").queryName("done").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("done").collect()
    want = obs.groupBy("service", "correlation_id").agg(F.min("source_ms").alias("first_ms")).collect()
    assert sorted((r.service, r.correlation_id, r.first_ms) for r in got) == sorted(tuple(r) for r in want)
    q = live.deduplicated(stream.unionByName(stream)).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == obs.count()


def test_streamed_decisions_equal_the_batch(spark, tmp_path):
    rows = [("t", "s", "a", 1, "x", "1"), ("t", "s", "a", 1, "x", "2"), ("t", "s", "a", 1, "y", "3"), ("t", "s", "b", 1, "z", "4"), ("t", "s", "b", 2, "z", "5"), ("t", "s", "c", 2, "z", "6"), ("t", "r", "a", 1, "x", "7")]
    df = spark.createDataFrame(rows, ARRIVAL)
    for i in range(3):
        df.where(F.ceil(F.col("arrival").cast("int") / 3) == i + 1).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = live.decisions(stream).writeStream.format("memory").queryName("decided").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {r.arrival: r.decision for r in spark.table("decided").collect()}
    assert got == {r.arrival: r.decision for r in ledger.decide(df).collect()}
    assert set(got.values()) == {"queued", "duplicate", "event_id_conflict", "sequence_conflict"}


def test_a_refused_event_owns_nothing(spark):
    rows = [("t", "s", "a", 1, "x", "1"), ("t", "s", "b", 2, "y", "2"), ("t", "s", "b", 2, "y", "3"), ("t", "s", "c", 2, "z", "4"), ("t", "s", "a", 1, "x", "5"), ("t", "s", "a", 1, "w", "6"), ("t", "s", "d", 1, "v", "7")]
    df = spark.createDataFrame(rows, ARRIVAL)
    got = [r.decision for r in ledger.decide(df, max_pending=1).orderBy("arrival").collect()]
    assert got == ["queued", "queue_full", "queue_full", "queue_full", "duplicate", "event_id_conflict", "sequence_conflict"]
    assert {r.decision for r in ledger.decide(df, max_pending=0).collect()} == {"queue_full"}
    assert ledger.decide(df, max_pending=99).where("decision = 'queue_full'").isEmpty()


def test_drain_moves_state_all_or_nothing(spark):
    rows = [("t", "s", f"e{i}", "pending" if i else "stored", f"0{i}", i != 3) for i in range(5)]
    df = spark.createDataFrame(rows, "tenant_id string, source_id string, event_id string, state string, ingested_at string, whole boolean")
    got = {r.event_id: r.state for r in ledger.drained(df, 2).collect()}
    assert [e for e in sorted(got) if got[e] == "stored"] == ["e0", "e1", "e2"]
    assert ledger.drained(df, 2, intact=F.col("whole")).where("state = 'stored'").count() == 3
    with pytest.raises(readers.ContractError):
        ledger.drained(df, 3, intact=F.col("whole"))
    assert ledger.drained(df).where("state = 'pending'").count() == 0


def test_digest_is_that_of_ascii_json(spark):
    import hashlib

    texts = ["plain", 'q"b\\s', "é\n", "\t\r\b\f\x00\x1f\x7f", "\U0001f600 ñ", ""]
    df = spark.createDataFrame([(7, t) for t in texts], "n long, t string")
    got = [r.h for r in df.select(normalize.content_hash(("t", False), ("n", True)).alias("h")).collect()]
    assert got == [hashlib.sha256(json.dumps([t, 7], separators=(",", ":"), ensure_ascii=True).encode()).hexdigest() for t in texts]


def test_inventory_keeps_paths(spark, tmp_path):
    for name in ("a/x", "b/x", "b/c d+e%41"):
        (tmp_path / "root (1)" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root (1)" / name).write_text(name)
    assert sorted(r.path for r in verify.inventory(spark, str(tmp_path / "root (1)")).collect()) == ["a/x", "b/c d+e%41", "b/x"]
    sinks.checksums(spark, str(tmp_path / "root (1)"), str(tmp_path / "sums"))
    assert sorted(r.path for r in readers.manifest(spark, str(tmp_path / "sums")).collect()) == ["a/x", "b/c d+e%41", "b/x"]


def test_numbering_over_ranges(spark):
    from evidentia.sources import storage

    df = spark.createDataFrame([(i % 3 == 0, f"k{(i * 37) % 500:03d}") for i in range(500)], "hot boolean, k string")
    want = {}
    for hot in (True, False):
        want |= {k: i for i, k in enumerate(sorted(r.k for r in df.collect() if r.hot == hot))}
    assert {r.k: r.place for r in storage.numbered(df, ["hot"], ["k"], "place").collect()} == want
    assert [storage.nth(df, ["k"], n).k if storage.nth(df, ["k"], n) else None for n in (1, 250, 500, 501)] == ["k000", "k249", "k499", None]


def test_pairs_across_services(spark):
    import hashlib
    import random

    rng = random.Random(5)
    chains = [(f"c{i:03d}", rng.choice("aaabc")) for i in range(60)]
    rows = [(9, f"e{c}", "p", f"s{c}", s, i, c, f"id-{c}") for i, (c, s) in enumerate(chains)]
    df = spark.createDataFrame(rows, "seed long, event_id string, source_type string, source_id string, service string, source_ms long, truth_chain_id string, correlation_id string")
    free = sorted(chains, key=lambda c: (hashlib.sha256(f"9\x1fx\x1f{c[0]}".encode()).hexdigest(), c[0]))
    want = set()
    while free:
        donor = free[0]
        other = [c for c in free if c[1] != donor[1]]
        if not other:
            break
        want.add((donor[0], other[0][0]))
        free = [c for c in free if c not in (donor, other[0])]
    assert {(r.donor, r.victim) for r in faults._pairs_cross(df, "x").collect()} == want


def test_readers_tell_what_is_wrong(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"x":1} {"x":')
    (tmp_path / "r/b.json").write_text('[{"y":2}]')
    got = sorted(((r.record or ""), bool(r.error)) for r in readers.json_records(spark, str(tmp_path / "r")).collect())
    assert got == [("", True), ('{"x":1}', False), ('{"y":2}', False)]
    (tmp_path / "c.csv").write_text("a,n\nx,1\ny,1.5z\n")
    assert [(r.n, r.error) for r in readers.csv(spark, str(tmp_path / "c.csv"), ["a", "n"], types={"n": "int"}).orderBy("a").collect()] == [(1, None), (None, "n")]
    (tmp_path / "t.json").write_text('{"targets":{"a":"v1.2.3"}}')
    assert readers.targets(spark, str(tmp_path / "t.json")) == {"a": "v1.2.3"}
    (tmp_path / "u.json").write_text('{"targets":{"a":"latest"}}')
    with pytest.raises(readers.ContractError):
        readers.targets(spark, str(tmp_path / "u.json"))
    nested = {"kvlistValue": {"values": [{"key": "b", "value": {"arrayValue": {"values": [{"intValue": "5"}, {"stringValue": "x"}]}}}, {"key": "a", "value": {"boolValue": True}}]}}
    df = spark.createDataFrame([(json.dumps(nested),), ('{"intValue":"7"}',), ("{}",)], "v string")
    assert [r.x for r in df.select(readers.any_value(F.col("v")).alias("x")).collect()] == ['{"a":true,"b":[5,"x"]}', "7", "null"]
    (tmp_path / "log").write_text("j\ts\tversion 1.2\nj\tt\tversion 9\nshort\n")
    assert [r.found for r in readers.marked_lines(spark, str(tmp_path / "log"), "j", "s", "[0-9.]+").collect()] == ["1.2"]


def test_bundles_appear_whole_or_not_at_all(spark, tmp_path):
    df = spark.range(3)
    sinks.bundle(spark, {"a": df, "b": df}, str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and readers.manifest(spark, str(tmp_path / "out/manifest")).count() > 2
    with pytest.raises(readers.ContractError):
        sinks.bundle(spark, {"a": df}, str(tmp_path / "out"))

    def refuse(parts):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        sinks.bundle(spark, {"a": df}, str(tmp_path / "other"), refuse)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    sinks.report(spark.range(1).toDF("x"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == '{"x":0}'
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.report(spark.range(1), str(tmp_path / "report"))
    with pytest.raises(readers.ContractError):
        sinks.csv(df.limit(0), str(tmp_path / "c"))
    sinks.raw_json(spark.createDataFrame([("{}",)], "raw string"), str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 1


def test_layout_trials(spark, tmp_path):
    df = normalize.unified(synthetic.fragmented(synthetic.planes(spark, 300, 20, 9137)))
    for layout in ("plain", "sorted"):
        verify.write_layout(df, str(tmp_path / layout), layout, files=2)
    got = verify.trial(spark, str(tmp_path), ("plain", "sorted"), {"service": "service = 'svc-0001'"}, warm=1)
    assert all(r["equal"] and r["pushed"] and r["rows"] > 0 for r in got)
    stats = verify.layout_stats(spark, str(tmp_path / "sorted")).first()
    assert stats.files == 2 and stats.bytes >= stats.largest > 0
    assert verify.constraint_errors(df, [["source_type", "source_id"]], ("service",), {"ts": "source_ts <> ''"}).isEmpty()
    with pytest.raises(readers.ContractError):
        links.seed(df.withColumn("source_id", F.col("source_id").cast("string")), "deployment", "none")


def test_extraction_needs_its_controls(spark):
    from evidentia.operators import extraction

    meta = lambda c: {"metadata": {"name": "d", "annotations": {"x.example/correlation-id": c}}}
    base = {"auditID": "1", "stage": "ResponseComplete", "requestReceivedTimestamp": "2026-01-01T00:00:00Z", "stageTimestamp": "2026-01-01T00:00:00Z", "verb": "create", "user": {"username": "me"}, "objectRef": {"apiGroup": "apps", "resource": "deployments", "namespace": "n", "name": "d"}, "responseStatus": {"code": 201}}
    good = base | {"requestObject": meta("c1")}
    denied = base | {"auditID": "2", "responseStatus": {"code": 403}}
    other = base | {"auditID": "3", "objectRef": base["objectRef"] | {"name": "plain"}}
    ask = lambda rows: extraction.extracted(spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string"), "raw", "x.example", "me", {"api_group": "apps", "resource": "deployments", "namespace": "n", "name": "d"}, "c1", "plain")
    assert sorted((r.source_id[0], r.binding, r.correlation_id) for r in ask([good, denied, other]).collect()) == [("1", "source_native_object_annotation", "c1"), ("2", "adapter_explicit_exact_target", "c1"), ("3", "absent", "")]
    for rows, names in (([good, denied], "negative"), ([good, other], "denials"), ([denied, other], "positive"), ([good, good, denied, other], "repeated")):
        with pytest.raises(readers.ContractError, match=names):
            ask(rows)


def test_sessions_and_file_pipeline(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2026-01-01 00:00:00"), ("s", "2026-01-01 00:00:05"), ("s", "2026-01-01 00:05:00"), ("s", "2026-01-01 09:00:00")], "service string, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.collected(live.sessions(stream, "t", "1 minute", "1 minute"), str(tmp_path / "out"), str(tmp_path / "ck"), None)
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect())[-2:] == [1, 2]
