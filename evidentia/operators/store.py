"""The governed store beside its ledger: inventories, status, checkpoints, access audit, tokens and collectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTROL, SHA256
from .ledger import gaps

#: The roles that a token may carry.
ALLOWED_ROLES = ("writer", "reader", "operator", "auditor")
STAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z\z"


def identifier(c: Column) -> Column:
    """Non-empty text of 512 characters at most without control characters."""
    return F.coalesce((c != "") & (F.length(c) <= 512) & ~c.rlike(CONTROL), F.lit(False))


def utc(c: Column) -> Column:
    return F.coalesce(c.rlike(STAMP) & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def event_errors(names: tuple[str, ...] = ("tenant_id", "source_id", "event_id"), times: tuple[str, ...] = ("source_ts",), payload: str | None = None) -> Column:
    """Why an event can't enter the store, as an array."""
    said = [F.when(~identifier(F.col(n)), f"invalid {n}") for n in names]
    said.append(F.when(~F.coalesce(F.col("sequence") >= 0, F.lit(False)), "invalid sequence"))
    said += [F.when(~utc(F.col(t)), f"invalid {t}") for t in times]
    if payload:
        said.append(F.when(~F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False)), "payload is no object"))
    return F.array_compact(F.array(*said))


INVENTORY = ["tenant_id", "source_id", "inventory_id"]


def inventory_fingerprint(members: DataFrame) -> DataFrame:
    """(inventory.., expected, distinct, fingerprint): members (inventory.., event_id) in any order give the same, by sums of hashes."""
    h = F.sha2("event_id", 256)
    sums = F.concat_ws(",", *[F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(1, 65, 8)])
    return members.groupBy(*INVENTORY).agg(F.count("*").alias("expected"), F.count_distinct("event_id").alias("distinct"), F.sha2(sums, 256).alias("fingerprint"))


def register(offers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """offers (inventory.., fingerprint, arrival) with status: registered, duplicate or inventory_id_conflict.

    An id keeps the content that it was first registered with; only new ones are to be appended.
    """
    owner = offers.groupBy(*INVENTORY).agg(F.min(F.struct("arrival", "fingerprint")).alias("first"))
    own, at = F.col("first.fingerprint"), F.col("first.arrival")
    if known is not None:
        owner = owner.join(known.select(*INVENTORY, F.col("fingerprint").alias("known")), INVENTORY, "left")
        own, at = F.coalesce("known", F.col("first.fingerprint")), F.when(F.col("known").isNull(), F.col("first.arrival"))
    owner = owner.select(*INVENTORY, own.alias("own"), at.alias("at"))
    status = F.when(F.col("fingerprint") != F.col("own"), "inventory_id_conflict").when(F.coalesce(F.col("arrival") == F.col("at"), F.lit(False)), "registered").otherwise("duplicate")
    return offers.join(owner, INVENTORY).withColumn("status", status).drop("own", "at")


def latest(inventories: DataFrame, order: str = "registered_at") -> DataFrame:
    """The inventory that each source registered last."""
    rest = [c for c in inventories.columns if c not in ("tenant_id", "source_id")]
    out = inventories.groupBy("tenant_id", "source_id").agg(F.max_by(F.struct(*rest), F.struct(order, "inventory_id")).alias("x"))
    return out.select("tenant_id", "source_id", "x.*")


def status(events: DataFrame, members: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row a source: counts by state, missing members of its latest inventory, gaps, quarantined items, last time, verdict.

    events: (tenant_id, source_id, event_id, sequence, state, ingested_at);
    members: (tenant_id, source_id, event_id) of the latest inventories. All
    are counts: members of a gap or of an inventory are never listed.
    """
    keys = ["tenant_id", "source_id"]
    by_state = events.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(f"{s}_count") for s in ("stored", "pending", "pruned")], F.max("ingested_at").alias("last_received_at"))
    there = events.where("state = 'stored'").select(*keys, "event_id").distinct().withColumn("there", F.lit(1))
    want = members.select(*keys, "event_id").distinct().join(there, [*keys, "event_id"], "left").groupBy(*keys).agg(F.count("*").alias("expected_count"), F.count_if(F.col("there").isNull()).alias("missing_count"))
    gap = gaps(events.where("state <> 'pruned'"), keys).groupBy(*keys).agg(F.count("*").alias("gap_ranges"), F.sum(F.col("last_missing") - F.col("first_missing") + 1).alias("gap_length"))
    bad = quarantine.groupBy(*keys).agg(F.count("*").alias("quarantine_count"))
    out = by_state.join(want, keys, "full").join(gap, keys, "left").join(bad, keys, "left")
    verdict = F.when(F.col("expected_count").isNull(), "UNKNOWN").when(F.col("missing_count") > 0, "INCOMPLETE").otherwise("COMPLETE")
    return out.withColumn("status", verdict).na.fill(0, ["stored_count", "pending_count", "pruned_count", "gap_ranges", "gap_length", "quarantine_count"])


def material(tables: dict[str, DataFrame], scope: str = "tenant_id") -> DataFrame:
    """(scope, part, rows, digest): a commitment to each table's rows, whatever their order or layout.

    A row's digest is that of its canonical JSON; rows add up in 256 buckets, so
    no task and no driver holds a tenant's rows.
    """
    out = None
    for part, df in sorted(tables.items()):
        h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        by = df.select(F.col(scope).alias("scope"), h.alias("h")).groupBy("scope", F.substring("h", 1, 2).alias("b"))
        sums = by.agg(F.count("*").alias("n"), F.concat_ws(",", *[F.sum(F.conv(F.substring("h", i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(1, 65, 8)]).alias("s"))
        one = sums.groupBy("scope").agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", F.col("n").cast("string"), "s"))), "\n"), 256).alias("digest"))
        one = one.select("scope", F.lit(part).alias("part"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def checkpoint(material_rows: DataFrame, store_id: str, sequence: int, issued_at: str, previous: str | None = None) -> DataFrame:
    """One row a scope: what an external anchor keeps."""
    body = material_rows.groupBy("scope").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", F.col("rows").cast("string"), "digest"))), "\n"), 256).alias("material_sha256"))
    return body.select("scope", F.lit(store_id).alias("store_id"), F.lit(sequence).cast("long").alias("sequence"), F.lit(issued_at).alias("issued_at"), "material_sha256", F.lit(previous).cast("string").alias("previous_sha256")).withColumn("checkpoint_sha256", F.sha2(F.concat_ws("|", "scope", "store_id", F.col("sequence").cast("string"), "issued_at", "material_sha256", F.coalesce("previous_sha256", F.lit(""))), 256))


def verified(current: DataFrame, anchors: DataFrame | None, now: str, most_age: str = "INTERVAL 3600 SECONDS") -> DataFrame:
    """(scope, result) of checkpoints made anew against protected anchors (scope, store_id, checkpoint_sha256, minimum_sequence, material_sha256, revoked).

    Without an anchor the result is UNKNOWN, never a pass.
    """
    if anchors is None:
        return current.select("scope", F.lit("UNKNOWN").alias("result"))
    a = anchors.select("scope", *[F.col(c).alias(f"__{c}") for c in ("store_id", "checkpoint_sha256", "minimum_sequence", "material_sha256", "revoked")])
    at = F.to_timestamp(F.lit(now))
    age = (F.to_timestamp("issued_at") > at) | (F.to_timestamp("issued_at") < at - F.expr(most_age))
    result = (
        F.when(F.col("__checkpoint_sha256").isNull(), "UNKNOWN")
        .when(F.col("__revoked"), "authority not trusted")
        .when(F.col("store_id") != F.col("__store_id"), "scope mismatch")
        .when(F.col("sequence") < F.col("__minimum_sequence"), "sequence below floor")
        .when(age, "outside freshness")
        .when(F.col("material_sha256") != F.col("__material_sha256"), "evidence differs")
        .when(F.col("checkpoint_sha256") != F.col("__checkpoint_sha256"), "other checkpoint")
        .otherwise("VERIFIED_RELATIVE_TO_CHECKPOINT")
    )
    return current.join(a, "scope", "left").select("scope", result.alias("result"))


def authorized(requests: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """requests (subject, tenant_id, roles, action, target_tenant, time) as access-audit rows with outcome: granted or denied."""
    needed = F.create_map(*[x for a, roles in required.items() for x in (F.lit(a), F.array(*map(F.lit, roles)))])
    ok = (F.col("tenant_id") == F.col("target_tenant")) & F.arrays_overlap("roles", F.try_element_at(needed, F.col("action")))
    return requests.select("time", "tenant_id", "subject", "action", F.when(F.coalesce(ok, F.lit(False)), "granted").otherwise("denied").alias("outcome"))


def access_log(audit: DataFrame, tenant: str) -> DataFrame:
    """One tenant's rows of the audit, in order."""
    return audit.where(F.col("tenant_id") == tenant).orderBy("time", "subject", "action")


def authenticated(requests: DataFrame, policies: DataFrame, now: str) -> DataFrame:
    """requests (.., token) with subject, tenant_id and roles of the one policy that matches, and accepted.

    policies: (token_sha256, subject, tenant_id, roles, valid_until, revoked).
    A token must have 32 to 4096 characters and match exactly one policy, which
    is neither revoked nor expired and has known roles only. Tokens leave as hashes.
    """
    p = policies.where(F.col("token_sha256").rlike(SHA256)).groupBy("token_sha256").agg(F.count("*").alias("__n"), F.max(F.struct("subject", "tenant_id", "roles", "valid_until", "revoked")).alias("__p"))
    sized = F.length("token").between(32, 4096)
    rows = requests.withColumn("token_sha256", F.when(sized, F.sha2("token", 256))).drop("token").join(p, "token_sha256", "left")
    known = (F.size("__p.roles") > 0) & (F.size(F.array_except(F.col("__p.roles"), F.array(*map(F.lit, ALLOWED_ROLES)))) == 0)
    ok = F.coalesce((F.col("__n") == 1) & ~F.col("__p.revoked") & (F.to_timestamp(F.lit(now)) < F.to_timestamp("__p.valid_until")) & known & identifier(F.col("__p.subject")), F.lit(False))
    pick = lambda c: F.when(ok, F.col(f"__p.{c}")).alias(c)
    return rows.select(*[c for c in requests.columns if c != "token"], "token_sha256", pick("subject"), pick("tenant_id"), pick("roles"), ok.alias("accepted"))


def origin(url: Column) -> Column:
    """The canonical HTTPS origin of a URL without credentials, path, query or fragment: host in lower case, no default port; else null."""
    shape = r"\Ahttps://(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]\s]+)(?::([0-9]{1,5}))?/?\z"
    host, port = F.lower(F.regexp_extract(url, shape, 1)), F.regexp_extract(url, shape, 2)
    number = port.try_cast("int")
    end = F.when((port == "") | (number == 443) | (number == 0), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    return F.when((host != "") & (F.coalesce(number, F.lit(0)) <= 65535), F.concat(F.lit("https://"), host, end))


def collected(statements: DataFrame, policies: DataFrame, now: str, age: str = "INTERVAL 300 SECONDS", skew: str = "INTERVAL 30 SECONDS") -> DataFrame:
    """statements (key_id, tenant_id, source_id, collector_id, adapter_sha256, issued_at, method, origin, raw_sha256) with error: why a collector isn't believed, or null.

    policies: (key_id, the same identity, valid_from, valid_until, allowed_origins, allow_fixture, revoked). Signatures are checked elsewhere.
    """
    same = ("tenant_id", "source_id", "collector_id", "adapter_sha256")
    p = policies.select("key_id", *[F.col(c).alias(f"__{c}") for c in (*same, "valid_from", "valid_until", "allowed_origins", "allow_fixture", "revoked")])
    at, issued, since, until = F.to_timestamp(F.lit(now)), F.to_timestamp("issued_at"), F.to_timestamp("__valid_from"), F.to_timestamp("__valid_until")
    mismatch = F.lit(False)
    for c in same:
        mismatch = mismatch | ~F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    error = (
        F.when(F.col("__revoked").isNull() | F.col("__revoked"), "not trusted")
        .when(~((since <= at) & (at < until)), "key not valid now")
        .when(mismatch, "identity differs")
        .when(~((since <= issued) & (issued < until)), "issued outside validity")
        .when((issued > at + F.expr(skew)) | (issued < at - F.expr(age)), "outside freshness")
        .when(~F.coalesce(F.array_contains("__allowed_origins", origin(F.col("origin"))), F.lit(False)), "origin not allowed")
        .when(~F.col("method").isin("https", "fixture"), "unsupported method")
        .when((F.col("method") == "fixture") & ~F.col("__allow_fixture"), "fixture forbidden")
        .when(~F.col("raw_sha256").rlike(SHA256), "malformed digest")
    )
    return statements.join(p, "key_id", "left").select(*statements.columns, error.alias("error"))


def stage(execution: Column, attestation: Column) -> Column:
    """One outcome of an execution and the attestation after it; null where the two can't be."""
    known = ("success", "failure", "cancelled", "skipped")
    valid = execution.isin(*known) & attestation.isin(*known)
    ran = execution == "success"
    return F.when(valid & ~ran & (attestation == "skipped"), F.concat(F.lit("execution_"), execution)).when(valid & ran & (attestation != "success"), F.concat(F.lit("attestation_"), attestation)).when(valid & ran, "attestation_completed_requires_verification")


def identity_mismatches(observed: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """(by.., name, expected, observed): fields of an identity that are not as expected; expected: (name, value). An absent field is a mismatch."""
    have = observed.select(*by, "name", F.col("value").alias("observed"))
    # as many rows as an identity has fields
    want = observed.select(*by).distinct().withColumn("f", F.explode(F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["value"]).alias("expected")) for r in expected.collect()]))).select(*by, "f.*")
    return want.join(have, [*by, "name"], "left").where(~F.col("expected").eqNullSafe(F.col("observed"))).select(*by, "name", "expected", "observed")
