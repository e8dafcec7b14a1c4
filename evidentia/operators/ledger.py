"""Governed ingestion: decisions, inventories, gaps, holds and retention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import ContractError
from ..sources.storage import nth, stored

SOURCE = ("tenant_id", "source_id")


def _sequential(rows: pd.DataFrame) -> pd.DataFrame:
    """Decisions of one source's arrivals in order: only accepted events own their id and sequence."""
    rows = rows.assign(new=rows["state"].isna()).sort_values(["new", "arrival", "fingerprint", "event_id", "sequence"], kind="stable", ignore_index=True).drop(columns="new")
    owner: dict = {}
    taken: set = set()
    out = []
    for event, seq, digest, state in rows[["event_id", "sequence", "fingerprint", "state"]].itertuples(index=False):
        if pd.notna(state):  # already in the ledger
            owner[event] = (digest, state)
            taken.add(seq)
            out.append(None)
        elif event in owner and owner[event][0] == digest:
            out.append("pruned" if owner[event][1] == "pruned" else "duplicate")
        elif event in owner or seq in taken:
            out.append("event_id_conflict" if event in owner else "sequence_conflict")
        else:
            owner[event] = (digest, "pending")
            taken.add(seq)
            out.append("queued")
    rows["decision"] = out
    return rows


def decide(batch: DataFrame, ledger: DataFrame | None = None, max_pending: int | None = None) -> DataFrame:
    """batch with decision: duplicate, pruned, event_id_conflict, sequence_conflict, queue_full or queued.

    batch: (tenant_id, source_id, event_id, sequence, fingerprint, arrival);
    ledger: the same with state in pending, stored, pruned. The first arrival
    of an id owns it, and that of a sequence likewise; of equal arrivals the
    smaller fingerprint comes first. Where an id's first arrival doesn't own
    its sequence, or the reverse, what is owned depends on the whole order;
    only such sources are replayed one arrival after the other.

    max_pending: a full queue refuses, and what is refused owns nothing. Before
    the arrival that fills it no decision differs; after it only rows that the
    ledger or the queue holds already can be repeated or contradicted.
    """
    out = _decided(batch, ledger)
    if max_pending is None:
        return out
    pending = 0 if ledger is None else ledger.where("state = 'pending'").count()
    out = stored(out, "decisions")
    last = nth(out.where("decision = 'queued'"), ORDER, max_pending - pending)
    if last is None and pending < max_pending:
        return out
    at = F.struct(*[F.col(c) for c in ORDER])
    fits = F.lit(False) if last is None else at <= F.struct(*[F.lit(last[c]).cast(out.schema[c].dataType).alias(c) for c in ORDER])
    rows = out.withColumn("fits", fits)
    early = rows.where("fits").drop("fits")
    held = early.where("decision = 'queued'").select(*COLUMNS[:-1], F.lit("pending").alias("state"))
    if ledger is not None:
        held = held.unionByName(ledger.select(*COLUMNS[:-1], "state"))
    by_id = held.select(*SOURCE, "event_id", F.col("fingerprint").alias("own"), F.col("state").alias("own_state"))
    by_seq = held.select(*SOURCE, "sequence", F.lit(True).alias("taken"))
    late = rows.where("not fits").drop("fits", "decision")
    for other, part in ((by_id, "event_id"), (by_seq, "sequence")):
        # a null id or sequence is one like any other, as in the windows of an open queue
        late, other = late.alias("x"), other.alias("y")
        late = late.join(other, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*SOURCE, part)], "left").select("x.*", *[F.col(f"y.{c}") for c in other.columns if c not in (*SOURCE, part)])
    same = F.col("own") == F.col("fingerprint")
    decision = F.when(same, F.when(F.col("own_state") == "pruned", "pruned").otherwise("duplicate")).when(F.col("own").isNotNull(), "event_id_conflict").when(F.col("taken"), "sequence_conflict").otherwise("queue_full")
    return early.unionByName(late.withColumn("decision", decision).select(*COLUMNS, "decision"))


COLUMNS = ["tenant_id", "source_id", "event_id", "sequence", "fingerprint", "arrival"]
#: One order of all arrivals; within a source it is (arrival, fingerprint, event_id, sequence).
ORDER = ["arrival", "fingerprint", "tenant_id", "source_id", "event_id", "sequence"]


def _decided(batch: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """decide() for a queue without bound."""
    cols = COLUMNS
    rows = batch.select(*cols, F.lit(None).cast("string").alias("state"))
    if ledger is not None:
        rows = rows.unionByName(ledger.select(*cols[:-1], F.lit(None).cast(batch.schema["arrival"].dataType).alias("arrival"), "state"))
    order = [F.col("state").isNotNull().desc(), F.col("arrival").asc_nulls_first(), "fingerprint", "event_id", "sequence"]
    by_id = Window.partitionBy(*SOURCE, "event_id").orderBy(*order)
    by_seq = Window.partitionBy(*SOURCE, "sequence").orderBy(*order)
    first = lambda w, c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.select("*", F.row_number().over(by_id).alias("nth_id"), F.row_number().over(by_seq).alias("nth_seq"), first(by_id, "fingerprint").alias("own"), first(by_id, "state").alias("own_state"))
    tangled = rows.groupBy(*SOURCE).agg(F.bool_or((F.col("nth_id") == 1) != (F.col("nth_seq") == 1)).alias("tangled"))
    rows = rows.join(tangled, list(SOURCE))
    plain = rows.where("not tangled and state is null").withColumn(
        "decision",
        F.when(F.col("nth_id") == 1, "queued")
        .when(F.col("own") == F.col("fingerprint"), F.when(F.col("own_state") == "pruned", "pruned").otherwise("duplicate"))
        .otherwise("event_id_conflict"),
    )
    hard = rows.where("tangled").select(*cols, "state")
    kinds = {f.name: f.dataType.simpleString() for f in hard.schema}
    replayed = hard.groupBy(*SOURCE).applyInPandas(_sequential, ", ".join(f"{c} {kinds[c]}" for c in [*cols, "state"]) + ", decision string")
    return plain.select(*cols, "decision").unionByName(replayed.where("decision is not null").select(*cols, "decision"))


def quarantined(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("decision").isin("event_id_conflict", "sequence_conflict"))


def drain(ledger: DataFrame, limit: int, order: tuple[str, ...] = ("ingested_at", "event_id")) -> DataFrame:
    """The pending rows that the next drain stores: a top-k by arrival."""
    return ledger.where("state = 'pending'").orderBy(*order).limit(limit)


def drained(ledger: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("ingested_at", "event_id"), intact: Column | None = None) -> DataFrame:
    """ledger after a drain: its first pending rows are stored. All or nothing: if one of them isn't intact, none moves and it raises."""
    pending = F.col("state") == "pending"
    last = nth(ledger.where(pending), list(order), limit) if limit else None
    taken = pending if last is None else pending & (F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(ledger.schema[c].dataType).alias(c) for c in order]))
    if intact is not None and not ledger.where(taken & ~F.coalesce(intact, F.lit(False))).isEmpty():
        raise ContractError("a pending row is not intact; nothing was stored")
    return ledger.withColumn("state", F.when(taken, "stored").otherwise(F.col("state")))


def gaps(df: DataFrame, keys: list[str], sequence: str = "sequence") -> DataFrame:
    """(keys.., first_missing, last_missing): ranges between neighbouring sequences; pruned rows are left out before."""
    after = F.lead(sequence).over(Window.partitionBy(*keys).orderBy(sequence))
    rows = df.select(*keys, sequence).distinct().withColumn("__next", after)
    return rows.where(F.col("__next") > F.col(sequence) + 1).select(*keys, (F.col(sequence) + 1).alias("first_missing"), (F.col("__next") - 1).alias("last_missing"))


def completeness(expected: DataFrame, stored: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Per keys: expected, stored and missing counts and a status; keys without an inventory are UNKNOWN.

    expected, stored: (keys.., member). Only distinct members are exchanged.
    """
    e = expected.select(*keys, member).distinct().withColumn("__e", F.lit(1))
    s = stored.select(*keys, member).distinct().withColumn("__s", F.lit(1))
    both = e.join(s, [*keys, member], "full")
    out = both.groupBy(*keys).agg(F.count("__e").alias("expected_count"), F.count("__s").alias("stored_count"), F.expr("count_if(__e = 1 and __s is null)").alias("missing_count"))
    status = F.when(F.col("expected_count") == 0, "UNKNOWN").when(F.col("missing_count") > 0, "INCOMPLETE").otherwise("COMPLETE")
    return out.withColumn("status", status)


def _due(before: Column) -> Column:
    return (F.col("ingested_at") < before) & (F.col("state") != "pruned")


def prune(ledger: DataFrame, before: Column, payload: tuple[str, ...] = ("payload",)) -> DataFrame:
    """ledger after retention: older rows without a hold become tombstones that keep their fingerprint."""
    gone = _due(before) & ~F.col("held")
    changes = {c: F.when(~gone, F.col(c)) for c in payload if c in ledger.columns}
    return ledger.withColumns(changes | {"state": F.when(gone, "pruned").otherwise(F.col("state"))})


def receipts(ledger: DataFrame, before: Column, reason: str) -> DataFrame:
    """(tenant_id, reason, deleted_count, held_count, deleted_sha256): what a prune of the same rows deletes and what holds keep.

    The digest adds up hashes of the deleted identities, so it needs no order and no list of them in one place.
    """
    due = ledger.where(_due(before))
    h = F.when(~F.col("held"), F.sha2(F.concat_ws("\x1f", "source_id", "event_id"), 256))
    sums = F.concat_ws(",", *[F.coalesce(F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(1, 65, 8)])
    out = due.groupBy("tenant_id").agg(F.expr("count_if(not held)").alias("deleted_count"), F.count_if("held").alias("held_count"), F.sha2(sums, 256).alias("deleted_sha256"))
    return out.select("tenant_id", F.lit(reason).alias("reason"), "deleted_count", "held_count", "deleted_sha256")


def hold(ledger: DataFrame, ids: DataFrame, value: bool = True, keys: tuple[str, ...] = ("tenant_id", "source_id", "event_id")) -> DataFrame:
    marked = ids.select(*keys, F.lit(value).alias("__held")).distinct()
    return ledger.join(marked, list(keys), "left").withColumn("held", F.coalesce("__held", "held")).drop("__held")


def allowed(df: DataFrame, roles: str, required: list[str], tenant: str) -> Column:
    """Whether a principal has one of the roles and the tenant."""
    return F.arrays_overlap(F.col(roles), F.array(*map(F.lit, required))) & (F.col("tenant_id") == tenant)


def seal(body: Column, key: bytes, aad: Column) -> Column:
    """AES-256-GCM with associated data, so a body opens only under its own identity."""
    return F.aes_encrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), aad)


def unseal(sealed: Column, key: bytes, aad: Column) -> Column:
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad)
