"""Typed, scoped links: validation, resolution with abstention, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SHA256, falsy, valid_text, valid_time
from ..sources.readers import ContractError
from ..sources.storage import stored

#: Closed sets of the profile.
LINK_TYPES = ("correlation_id", "run_id", "artifact_digest", "resource_uid", "change_id", "trace_id", "custom")
SCOPE_TYPES = ("global", "repository", "cluster", "namespace", "tenant", "organization")
METHODS = ("source_native", "adapter_explicit", "inferred")
CUSTOM_TYPE = r"\A[a-z][a-z0-9.-]*/[a-z][a-z0-9_.-]*\z"

LINK = "array<struct<type:string,custom_type:string,value:string,scope:struct<type:string,id:string>,evidence_method:string,confidence:double>>"
KEY = ["type", "custom_type", "scope_type", "scope_id", "value"]


def exploded(df: DataFrame, keys: tuple[str, ...] = ("source_type", "source_id"), links: str = "links") -> DataFrame:
    """One row a link with its key and its position."""
    rows = df.select(*keys, F.posexplode(links).alias("position", "l"))
    return rows.select(*keys, "position", "l.type", "l.custom_type", F.col("l.scope.type").alias("scope_type"), F.col("l.scope.id").alias("scope_id"), "l.value", "l.evidence_method", "l.confidence")


def _said(cond: Column, message: str | Column) -> Column:
    return F.when(cond, F.lit(message) if isinstance(message, str) else message)


def errors(links: str = "links") -> Column:
    """All violations of a record, in order: its own fields first, then each link's by index, then repeated keys."""
    own = F.array_compact(
        F.array(
            *[_said(~valid_text(F.col(c)), f"{c}: invalid text") for c in ("source_type", "source_id", "intent", "policy", "action", "outcome")],
            *[_said(~valid_time(F.col(c)), f"{c}: invalid timestamp") for c in ("source_ts", "observed_ts")],
            _said(F.col("content_hash").isNotNull() & ~F.col("content_hash").rlike(SHA256), "content_hash: invalid digest"),
        )
    )

    def one(x: Column, i: Column) -> Column:
        at = lambda m: F.format_string(f"links[%d].{m}", i)
        inferred = x["evidence_method"] == "inferred"
        return F.array_compact(
            F.array(
                _said(~F.coalesce(x["type"].isin(*LINK_TYPES), F.lit(False)), at("type: unsupported")),
                _said((x["type"] == "custom") & ~F.coalesce(x["custom_type"].rlike(CUSTOM_TYPE), F.lit(False)), at("custom_type: required")),
                _said((x["type"] != "custom") & x["custom_type"].isNotNull(), at("custom_type: not permitted")),
                _said(~F.coalesce(x["scope"]["type"].isin(*SCOPE_TYPES), F.lit(False)), at("scope.type: unsupported")),
                _said(~valid_text(x["value"]), at("value: invalid text")),
                _said(~F.coalesce(x["evidence_method"].isin(*METHODS), F.lit(False)), at("evidence_method: unsupported")),
                _said(inferred & ~F.coalesce(x["confidence"].between(0, 1), F.lit(False)), at("confidence: required in [0, 1]")),
                _said(~inferred & x["confidence"].isNotNull(), at("confidence: only for inferred links")),
            )
        )

    per_link = F.flatten(F.transform(F.col(links), one))
    keys = F.transform(F.col(links), lambda x: F.concat_ws("\x1f", x["type"], F.coalesce(x["custom_type"], F.lit("")), x["scope"]["type"], x["scope"]["id"], x["value"]))
    again = _said(F.size(keys) != F.size(F.array_distinct(keys)), "links: duplicate key")
    return F.concat(own, F.coalesce(per_link, F.array().cast("array<string>")), F.array_compact(F.array(again)))


def eligible(links: DataFrame, link_type: str, custom_type: str | None = None, scope: tuple[str, str] | None = None, allow_inferred: bool = False, minimum: float = 1.0) -> DataFrame:
    """Exploded links of a type that a resolution may use."""
    out = links.where(F.col("type") == link_type)
    if link_type == "custom":
        out = out.where(F.col("custom_type") == custom_type)
    if scope:
        out = out.where((F.col("scope_type") == scope[0]) & (F.col("scope_id") == scope[1]))
    sure = F.col("evidence_method") != "inferred"
    return out.where(sure | (F.coalesce(F.col("confidence") >= minimum, F.lit(False)) if allow_inferred else F.lit(False)))


def resolve(links: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ("source_type", "source_id"), **rules) -> DataFrame:
    """Per seed: (keys.., status, reason, selected_type, selected_scope, selected_value, matches, excluded). A seed with none or several keys abstains: missing, ambiguous.

    Peers share the seed's key and are looked up in its scope; a peer with
    several keys there is excluded, not matched. All seeds resolve in one join.
    """
    rows = eligible(links, **rules)
    k = list(keys)
    # each of the three uses would make the links anew
    known = stored(rows.select(*k, *KEY).distinct(), "links")
    per = known.groupBy(*k).agg(F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("key"))
    seed = seeds.select(*k).distinct().join(per, k, "left")
    # a peer's keys in one scope
    scoped = known.groupBy(*k, "scope_type", "scope_id").agg(F.count("*").alias("m"))
    peer = known.join(scoped, [*k, "scope_type", "scope_id"]).groupBy(*KEY).agg(F.expr("count_if(m = 1)").alias("matches"), F.expr("count_if(m > 1)").alias("excluded"))
    one = seed.where("n = 1").select(*k, *[F.col(f"key.{c}").alias(c) for c in KEY])
    cond = [one[c].eqNullSafe(peer[c]) for c in KEY]
    scope = F.concat_ws(":", one["scope_type"], one["scope_id"])
    done = one.join(peer, cond).select(*[one[c] for c in k], F.lit("resolved").alias("status"), F.lit("one_exact_link_key").alias("reason"), one["type"].alias("selected_type"), scope.alias("selected_scope"), one["value"].alias("selected_value"), "matches", "excluded")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    reason = F.when(F.col("n").isNull(), "no_eligible_link").otherwise("multiple_eligible_link_keys")
    rest = seed.where("n is null or n > 1").select(*k, F.when(F.col("n").isNull(), "missing").otherwise("ambiguous").alias("status"), reason.alias("reason"), none.alias("selected_type"), none.alias("selected_scope"), none.alias("selected_value"), zero.alias("matches"), zero.alias("excluded"))
    return done.unionByName(rest)


def memberships(links: DataFrame, keys: tuple[str, ...] = ("source_type", "source_id"), **rules) -> DataFrame:
    """(link key.., keys.., member): who matches a link key and who is excluded, for it has several in that scope.

    With the key that resolve() selects for a seed this is its list of matches; it is stated once a key, not once a seed.
    """
    known = eligible(links, **rules).select(*keys, *KEY).distinct()
    scoped = known.groupBy(*keys, "scope_type", "scope_id").agg(F.count("*").alias("m"))
    return known.join(scoped, [*keys, "scope_type", "scope_id"]).select(*KEY, *keys, F.when(F.col("m") == 1, "match").otherwise("excluded").alias("member"))


def seed(df: DataFrame, source_type: str, source_id: str) -> DataFrame:
    """The record of a source; raises if there is none."""
    found = df.where((F.col("source_type") == source_type) & (F.col("source_id") == source_id))
    if found.isEmpty():
        raise ContractError(f"no record of {source_type} {source_id}")
    return found


def migrated(df: DataFrame, scope_type: str = "global", scope_id: str = "legacy") -> DataFrame:
    """Rows of the flat evidence table as profile records; the whole original row stays in extensions."""
    link = F.array_compact(
        F.array(
            F.when(
                falsy(F.col("correlation_id")).isNotNull(),
                F.struct(F.lit("correlation_id").alias("type"), F.lit(None).cast("string").alias("custom_type"), F.col("correlation_id").alias("value"), F.struct(F.lit(scope_type).alias("type"), F.lit(scope_id).alias("id")).alias("scope"), F.lit("adapter_explicit").alias("evidence_method"), F.lit(None).cast("double").alias("confidence")),
            )
        )
    ).cast(LINK)
    original = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.withColumns({"links": link, "extensions": original})
