"""Controlled extraction of audit records: scope, controls, unified metadata, public evidence and profile records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy
from ..sources.readers import ContractError
from .crossplane import canonical_json

META = "struct<metadata:struct<name:string,namespace:string,uid:string,labels:map<string,string>,annotations:map<string,string>>>"
PUBLIC = f"auditID string, stage string, requestReceivedTimestamp string, stageTimestamp string, verb string, user struct<username:string>, impersonatedUser struct<username:string>, objectRef struct<apiGroup:string,resource:string,namespace:string,name:string,uid:string>, requestObject {META}, responseObject {META}, responseStatus struct<code:int>"


def scoped(df: DataFrame, raw: str, namespace: str) -> DataFrame:
    """df with disposition: kept, other_namespace or unscoped, by the object reference alone; a request's path never gives a scope."""
    space = F.get_json_object(raw, "$.objectRef.namespace")
    return df.withColumn("disposition", F.when(space.isNull(), "unscoped").when(space == namespace, "kept").otherwise("other_namespace"))


def in_namespace(df: DataFrame, raw: str, namespace: str) -> DataFrame:
    """Records of one namespace that are no token requests."""
    return scoped(df, raw, namespace).where((F.col("disposition") == "kept") & F.coalesce(F.get_json_object(raw, "$.objectRef.subresource") != "token", F.lit(True))).drop("disposition")


def _merged(x: Column, y: Column) -> tuple[Column, Column]:
    """(whether two maps contradict each other, both as one)."""
    contradict = F.exists(F.map_keys(x), lambda k: F.coalesce(F.try_element_at(y, k) != F.try_element_at(x, k), F.lit(False)))
    return contradict, F.map_concat(x, F.map_filter(y, lambda k, _: ~F.map_contains_key(x, k)))


def unified_metadata(df: DataFrame, raw: str) -> DataFrame:
    """df with the parsed record r, its labels and annotations of request and response together, its identity, and conflict: why they can't be one."""
    rows = df.withColumn("r", F.from_json(raw, PUBLIC))
    a, b = F.col("r.requestObject.metadata"), F.col("r.responseObject.metadata")
    none = F.create_map().cast("map<string,string>")
    out, conflicts = {}, []
    for name in ("labels", "annotations"):
        conflict, out[name] = _merged(F.coalesce(a[name], none), F.coalesce(b[name], none))
        conflicts.append(F.when(conflict, f"{name} differ"))
    for name in ("name", "namespace", "uid"):
        whole = F.coalesce(a[name], b[name])
        conflicts.append(F.when((a[name] != b[name]) | (whole != F.col(f"r.objectRef.{name}")), f"{name} differs"))
        out[f"meta_{name}"] = whole
    return rows.withColumns(out | {"conflict": F.array_compact(F.array(*conflicts))})


def evidence(df: DataFrame, raw: str, domain: str, principal: str, target: dict[str, str], correlation_id: str) -> DataFrame:
    """Public records as evidence: a binding is native, or explicit where the principal's 403 hit exactly the target, or absent and then empty."""
    rows = unified_metadata(df, raw)
    name = F.coalesce(falsy(F.col("r.objectRef.name"), F.col("meta_name")), F.lit("unknown-object"))
    native = falsy(F.try_element_at("annotations", F.lit(f"{domain}/correlation-id")))
    actor = F.coalesce(falsy(F.col("r.impersonatedUser.username"), F.col("r.user.username")), F.lit("unknown"))
    code = F.coalesce("r.responseStatus.code", F.lit(0))
    hit = (F.coalesce("r.objectRef.apiGroup", F.lit("")) == target["api_group"]) & (F.col("r.objectRef.resource") == target["resource"]) & (F.col("r.objectRef.namespace") == target["namespace"]) & (name == target["name"])
    explicit = native.isNull() & (actor == principal) & (code == 403) & hit
    source_ts = F.coalesce(falsy(F.col("r.requestReceivedTimestamp"), F.col("r.stageTimestamp")), F.lit(""))
    return rows.select(
        *df.columns,
        "r",
        "labels",
        "annotations",
        "conflict",
        F.lit("kubernetes.audit").alias("source_type"),
        F.concat(F.col("r.auditID"), F.lit(":"), F.col("r.stage")).alias("source_id"),
        source_ts.alias("source_ts"),
        F.coalesce(falsy(F.col("r.stageTimestamp")), source_ts).alias("observed_ts"),
        actor.alias("actor"),
        F.concat("r.objectRef.namespace", F.lit("/"), F.coalesce(falsy(F.try_element_at("labels", F.lit("app.kubernetes.io/name"))), name)).alias("service"),
        F.col("r.verb").alias("action"),
        code.cast("string").alias("outcome"),
        F.concat(F.lit("kubernetes-audit://"), F.col("r.auditID")).alias("source_pointer"),
        F.coalesce(native, F.when(explicit, correlation_id), F.lit("")).alias("correlation_id"),
        F.sha2(canonical_json(F.col(raw)), 256).alias("content_hash"),
        F.when(native.isNotNull(), "source_native_object_annotation").when(explicit, "adapter_explicit_exact_target").otherwise("absent").alias("binding"),
        name.alias("object_name"),
        hit.alias("on_target"),
        code.alias("code"),
    )


def controls(rows: DataFrame, correlation_id: str, principal: str, negative_name: str) -> DataFrame:
    """One row of counts: positive records, those on the target, exact denials, denials with an id, negative controls, those with an id, repeated identities, conflicts."""
    has = F.col("binding") == "source_native_object_annotation"
    positive = has & (F.col("correlation_id") == correlation_id)
    denial = F.col("on_target") & (F.col("actor") == principal) & (F.col("code") == 403)
    negative = F.col("object_name") == negative_name
    parts = {"positive": positive, "positive_on_target": positive & F.col("on_target"), "denials": denial, "denials_with_id": denial & has, "negative": negative, "negative_with_id": negative & has, "conflicts": F.size("conflict") > 0}
    again = rows.groupBy("source_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    # both sides are one row
    return rows.agg(F.count("*").alias("records"), *[F.count_if(c).alias(n) for n, c in parts.items()]).crossJoin(again)


def failed(c: DataFrame) -> DataFrame:
    """(control, failed) rows of what controls() must have."""
    rules = {"records": "records = 0", "repeated": "repeated > 0", "conflicts": "conflicts > 0", "positive": "positive = 0", "positive_on_target": "positive_on_target = 0", "denials": "denials = 0", "denials_with_id": "denials_with_id > 0", "negative": "negative = 0", "negative_with_id": "negative_with_id > 0"}
    return c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("control"), F.expr(e).alias("failed")) for n, e in rules.items()])).alias("x")).select("x.*")


def extracted(df: DataFrame, raw: str, domain: str, principal: str, target: dict[str, str], correlation_id: str, negative_name: str) -> DataFrame:
    """evidence() once all controls hold; raises with the names of those that don't."""
    rows = evidence(df, raw, domain, principal, target, correlation_id)
    if bad := [r["control"] for r in failed(controls(rows, correlation_id, principal, negative_name)).where("failed").collect()]:
        raise ContractError(f"controls failed: {', '.join(bad)}")
    return rows


def actor_reference(actor: Column, cluster: str, namespace: Column) -> Column:
    """Type and scope of a cluster actor, told by its prefix only; a bare name proves no human."""
    own = F.concat(F.lit(f"{cluster}/namespaces/"), namespace)
    account, system = actor.startswith("system:serviceaccount:"), actor.startswith("system:")
    type_ = F.when(account, "service_account").when(system, "system").otherwise("unknown")
    scope = F.struct(F.when(account, "namespace").otherwise("cluster").alias("type"), F.when(account, own).otherwise(cluster).alias("id"))
    return F.struct(actor.alias("id"), type_.alias("type"), scope.alias("scope"))


def _link(type_: str, value: Column, scope_type: str, scope_id: Column, method: Column | str = "source_native", custom: str | None = None) -> Column:
    return F.struct(F.lit(type_).alias("type"), F.lit(custom).cast("string").alias("custom_type"), value.alias("value"), F.struct(F.lit(scope_type).alias("type"), scope_id.alias("id")).alias("scope"), (F.lit(method) if isinstance(method, str) else method).alias("evidence_method"))


def profile_links(domain: str, cluster: str, experiment: str) -> Column:
    """Up to six typed links of an evidence() row."""
    note = lambda n: falsy(F.try_element_at("annotations", F.lit(f"{domain}/{n}")))
    repository = F.concat(F.lit("github://repositories/"), note("github-repository-id"))
    run = F.concat(repository, F.lit("/actions/runs/"), note("github-run-id"), F.lit("/attempts/"), note("github-run-attempt"))
    bound = F.col("binding") != "absent"
    method = F.when(F.col("binding") == "source_native_object_annotation", "source_native").otherwise("explicit")
    uid = F.coalesce(F.col("r.requestObject.metadata.uid"), F.col("r.responseObject.metadata.uid"))
    target = F.concat(F.lit("kubernetes://"), F.coalesce("r.objectRef.apiGroup", F.lit("")), F.lit("/"), F.col("r.objectRef.resource"), F.lit("/"), F.col("r.objectRef.namespace"), F.lit("/"), F.col("object_name"))
    return F.array_compact(
        F.array(
            F.when(bound, _link("operational_correlation", F.col("correlation_id"), "custom", F.lit(experiment), method)),
            F.when(F.col("binding") == "adapter_explicit_exact_target", _link("custom", target, "cluster", F.lit(cluster), custom="kubernetes_resource_target")),
            F.when(run.isNotNull(), _link("workflow_run", run, "repository", repository)),
            F.when(repository.isNotNull() & note("github-commit-sha").isNotNull(), _link("vcs_revision", note("github-commit-sha"), "repository", repository)),
            F.when(note("subject-uri").isNotNull() & note("subject-digest").isNotNull(), _link("artifact_digest", note("subject-digest"), "custom", F.concat(F.lit("oci://"), note("subject-uri")))),
            F.when(falsy(uid).isNotNull(), _link("deployment_uid", uid, "cluster", F.lit(cluster))),
        )
    )


def profile_records(rows: DataFrame, domain: str, cluster: str, experiment: str, profile: str = "evidence.profile/1.3") -> DataFrame:
    """(source_id, record): evidence() rows as profile records in JSON; the authenticated actor is the initiator where another acted."""
    space = F.col("r.objectRef.namespace")
    authenticated = F.coalesce(falsy(F.col("r.user.username")), F.lit("unknown"))
    actors = F.struct(actor_reference(F.col("actor"), cluster, space).alias("execution_principal"), F.when(F.col("actor") != authenticated, actor_reference(authenticated, cluster, space)).alias("initiator"))
    scope = F.struct(F.lit("namespace").alias("type"), F.concat(F.lit(f"{cluster}/namespaces/"), space).alias("id"))
    digest = F.struct(F.lit("sha256").alias("algorithm"), F.col("content_hash").alias("value"), F.lit("sanitized_canonical_json").alias("representation"), F.lit("UTF-8 JSON; keys sorted; compact").alias("canonicalization"))
    record = F.struct(
        actors.alias("actors"), F.col("action"), F.lit("software_delivery").alias("intent"), profile_links(domain, cluster, experiment).alias("links"), F.col("observed_ts"), F.col("outcome"), F.lit("kubernetes-rbac-admission").alias("policy"), F.lit(profile).alias("profile"),
        F.struct(F.col("service").alias("id"), F.lit("kubernetes_resource").alias("type"), scope.alias("scope")).alias("service"), digest.alias("source_digest"), F.col("source_id"), F.col("source_pointer"), F.col("source_ts"), F.col("source_type"),
    )
    return rows.select("source_id", canonical_json(F.to_json(record)).alias("record"))
