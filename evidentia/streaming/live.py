"""Streaming forms: replay suppression, ingest decisions, completion and anchored episodes with keyed state.

The batch operators define the results. Late rows are never dropped unless a
caller opts in with a watermark; state is then bounded by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.synthetic import PLANES


def deduplicated(stream: DataFrame, time: str | None = None, within: str | None = None) -> DataFrame:
    """The first observation of each source and payload; with time and within, state is kept that long only."""
    keys = ["source_type", "source_id", "payload_hash"]
    if time and within:
        return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def completions(stream: DataFrame, planes: tuple[str, ...] = PLANES, keep_ms: int | None = None) -> DataFrame:
    """(service, correlation_id, first_ms, done_ms) once all planes of a chain have been seen, in any order.

    keep_ms: a chain's state goes when no event of it came for so long; by
    default it stays, so that a repeated event never completes a chain again.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, first, last, done = state.get if state.exists else ("", 2**62, 0, False)
        names = set(filter(None, seen.split("|")))
        for p in parts:
            names |= set(p["source_type"])
            first, last = min(first, int(p["source_ms"].min())), max(last, int(p["arrival_ms"].max()))
        now = set(planes) <= names
        state.update(("|".join(sorted(names)), first, last, done or now))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        if now and not done:
            yield pd.DataFrame([(*key, first, last)], columns=["service", "correlation_id", "first_ms", "done_ms"])

    rows = stream.where(F.col("correlation_id").isNotNull()).groupBy("service", "correlation_id")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return rows.applyInPandasWithState(step, "service string, correlation_id string, first_ms long, done_ms long", "seen string, first long, last long, done boolean", "append", timeout)


DECISION = "tenant_id string, source_id string, event_id string, sequence long, fingerprint string, arrival string, decision string"


class _Owners(StatefulProcessor):
    """Who owns the ids and the sequences of one source, each an entry of its own in the state store."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "event_id string", "fingerprint string", self.keep_ms)
        self.sequences = handle.getMapState("sequences", "sequence long", "event_id string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        for p in rows:
            out = []
            for r in p.sort_values(["arrival", "fingerprint", "event_id", "sequence"]).itertuples(index=False):
                event, seq = (r.event_id,), (int(r.sequence),)
                if self.ids.containsKey(event):
                    decision = "duplicate" if self.ids.getValue(event)[0] == r.fingerprint else "event_id_conflict"
                elif self.sequences.containsKey(seq):
                    decision = "sequence_conflict"
                else:
                    self.ids.updateValue(event, (r.fingerprint,))
                    self.sequences.updateValue(seq, event)
                    decision = "queued"
                out.append((*key, r.event_id, *seq, r.fingerprint, r.arrival, decision))
            yield pd.DataFrame(out, columns=["tenant_id", "source_id", "event_id", "sequence", "fingerprint", "arrival", "decision"])

    def close(self) -> None:
        pass


def decisions(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Arrivals with their decision: queued, duplicate, event_id_conflict or sequence_conflict, in order of arrival within a source.

    The session's state store must be RocksDB. State holds one entry an id and
    one a sequence; with keep_ms an entry expires so long after it was written.
    """
    rows = stream.select("tenant_id", "source_id", "event_id", "sequence", "fingerprint", "arrival").groupBy("tenant_id", "source_id")
    return rows.transformWithStateInPandas(_Owners(keep_ms), DECISION, "append", "ProcessingTime" if keep_ms else "None")


def windowed(stream: DataFrame, time: str, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts a plane and window; rows later than the watermark are left out, which the caller chose."""
    win = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(win.alias("w"), "source_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source_type", "n")


def fresh(df: DataFrame, observed: str, received: str, age: str = "INTERVAL 300 SECONDS", skew: str = "INTERVAL 30 SECONDS") -> DataFrame:
    """Rows observed no longer than age before their receipt, and no later than skew after it."""
    return df.where(F.col(observed).between(F.col(received) - F.expr(age), F.col(received) + F.expr(skew)))


def sessions(stream: DataFrame, time: str, late: str, gap: str) -> DataFrame:
    """Counts of a service's sessions, which end after a gap; rows later than the watermark are left out, which the caller chose."""
    win = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy("service", win.alias("w")).agg(F.count("*").alias("n")).select("service", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def collected(stream: DataFrame, path: str, checkpoint: str, every: str | None = "100 milliseconds"):
    """A running query that appends a stream to Parquet files in small batches; without an interval it takes what is there and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
