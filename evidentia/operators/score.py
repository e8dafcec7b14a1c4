"""Quality of reconstructions against known chains."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BUCKET_ROWS = 5000


def _pairs(n):
    return (n * (n - 1) / 2).cast("long")


def arrival_inversions(df: DataFrame, by: tuple[str, ...], delay_ms: int, source: str = "truth_source_ms", arrival: str = "arrival_ms", key: str = "event_id") -> DataFrame:
    """(by.., inversions): pairs whose arrival order is not their source order.

    Events arrive within delay_ms of their source time, so an inverted pair
    lies in one bucket of that width or more, or in two neighbours: buckets
    are counted independently, each with the rows of the one before. Their
    width follows the rows' density.
    """
    cols = list(by)
    own = df.groupBy(*cols).agg(F.count("*").alias("n"), (F.max(source) - F.min(source)).alias("ms")).agg(F.max("ms"), F.max("n")).first()
    width_ms = max(delay_ms, int((own[0] or 0) / max(1.0, (own[1] or 0) / BUCKET_ROWS)))
    rows = df.select(*cols, F.col(key).alias("k"), F.col(source).alias("s"), F.col(arrival).alias("a"), F.floor(F.col(source) / width_ms).alias("b"))
    rows = rows.select(*cols, "k", "s", "a", F.explode(F.array(F.struct(F.col("b").alias("bucket"), F.lit(True).alias("own")), F.struct((F.col("b") + 1).alias("bucket"), F.lit(False).alias("own")))).alias("z")).select(*cols, "k", "s", "a", "z.bucket", "z.own")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema) if cols else ""

    def count(g: pd.DataFrame) -> pd.DataFrame:
        seen: list = []
        total = 0
        for own, a, k in g.sort_values(["s", "k"])[["own", "a", "k"]].itertuples(index=False):
            # those before in source order that arrive after; pairs of the bucket before are counted there
            if own:
                total += len(seen) - bisect.bisect_right(seen, (a, k))
            bisect.insort(seen, (a, k))
        return pd.DataFrame([[*(g[c].iloc[0] for c in cols), total]], columns=[*cols, "n"])

    parts = rows.groupBy(*cols, "bucket").applyInPandas(count, f"{kinds + ', ' if kinds else ''}n long")
    return parts.groupBy(*cols).agg(F.sum("n").alias("inversions"))


def evaluate(events: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row of metrics for each value of by. groups: a policy's rows for events.

    All counts come from aggregates by group and by chain; pairs are counted,
    not made, but for groups in which an event repeats, whose distinct
    canonical ids count once.
    """
    keys = list(by)
    truth = events.select(*keys, "event_id", "canonical_event_id", "truth_chain_id", "truth_source_ms", "arrival_ms", "source_type", "source_id", "observation_kind")
    canonical = truth.where("event_id = canonical_event_id")
    chain = canonical.groupBy(*keys, "truth_chain_id").agg(F.count("*").alias("size"), (F.max("arrival_ms") - F.min("truth_source_ms")).alias("ms"))
    rows = groups.join(truth, [*keys, "event_id"])

    group = rows.groupBy(*keys, "group_id").agg(F.count("*").alias("n"), F.count_distinct("canonical_event_id").alias("ids"), F.count_distinct("truth_chain_id").alias("chains"), F.min("truth_chain_id").alias("truth_chain_id"))
    members = rows.select(*keys, "group_id", "truth_chain_id", "canonical_event_id").distinct()
    inside = members.groupBy(*keys, "group_id", "truth_chain_id").agg(F.count("*").alias("m"))
    # an event and its conflicting copy may share several groups with another: such pairs count once
    homes = members.groupBy(*keys, "canonical_event_id").agg(F.count("*").alias("homes"))
    repeated = homes.where("homes > 1").select(*keys, "canonical_event_id")
    many = members.join(repeated, [*keys, "canonical_event_id"], "left_semi").select(*keys, "group_id", "truth_chain_id").distinct()
    again = members.join(many, [*keys, "group_id", "truth_chain_id"], "left_semi")
    other = again.select(*keys, "group_id", "truth_chain_id", F.col("canonical_event_id").alias("other"))
    twice = again.join(other, [*keys, "group_id", "truth_chain_id"]).where("canonical_event_id < other").groupBy(*keys, "truth_chain_id", "canonical_event_id", "other").agg((F.count("*") - 1).alias("x"))
    over = twice.groupBy(*keys).agg(F.sum("x").alias("over"))
    hit = inside.groupBy(*keys).agg(F.sum(_pairs(F.col("m"))).alias("inner"))

    exact = group.where("n = ids AND chains = 1").join(chain, [*keys, "truth_chain_id"]).where("n = size").select(*keys, "truth_chain_id", "ms").distinct()
    best = inside.groupBy(*keys, "truth_chain_id").agg(F.max("m").alias("m")).join(chain, [*keys, "truth_chain_id"], "right")
    cover = best.groupBy(*keys).agg(F.avg(F.coalesce("m", F.lit(0)) / F.col("size")).alias("mean_chain_member_coverage"))
    done = exact.groupBy(*keys).agg(F.count("*").alias("complete_chain_count"), F.percentile("ms", 0.5).alias("time_to_completeness_p50_ms"), F.percentile("ms", 0.95).alias("time_to_completeness_p95_ms"), F.max("ms").cast("double").alias("time_to_completeness_max_ms"))

    candidate = rows.where(F.col("candidate_id").isNotNull()).groupBy(*keys, "candidate_id").agg((F.count_distinct("truth_chain_id") > 1).alias("mixed"), F.bool_or("flagged").alias("flagged"))
    mixed_rows = rows.join(candidate.where("mixed").select(*keys, "candidate_id"), [*keys, "candidate_id"], "left_semi")
    ambiguous = mixed_rows.groupBy(*keys).agg(F.count_distinct("canonical_event_id").alias("ambiguous_event_count"))
    c = candidate.groupBy(*keys).agg(F.count_if("mixed").alias("ambiguous_group_count"), F.count_if("flagged").alias("detected_ambiguous_group_count"), F.count_if(F.col("mixed") & F.col("flagged")).alias("tp"))
    sources = truth.join(groups.select(*keys, "event_id"), [*keys, "event_id"], "left_semi")
    found = events.groupBy(*keys, "source_type", "source_id").agg((F.count_distinct("payload_hash") > 1).alias("found"), F.bool_or(F.col("observation_kind") == "conflicting_duplicate").alias("wanted"))
    conflict = found.groupBy(*keys).agg(F.count_if("wanted").alias("source_conflict_group_count"), F.count_if("found").alias("detected_source_conflict_group_count"), F.count_if(F.col("found") & F.col("wanted")).alias("ctp"))
    g = group.groupBy(*keys).agg(F.count("*").alias("predicted_group_count"), F.expr("count_if(ids >= 2)").alias("predicted_chain_group_count"), F.sum(_pairs(F.col("n"))).alias("predicted_join_pair_count"), F.expr("count_if(chains > 1)").alias("accepted_ambiguous_group_count"))
    t = chain.groupBy(*keys).agg(F.count("*").alias("truth_chain_count"), F.sum("size").alias("canonical_event_count"), F.sum(_pairs(F.col("size"))).alias("true_join_pair_count"))
    o = events.groupBy(*keys).agg(F.count("*").alias("observation_count"))
    a = groups.groupBy(*keys).agg(F.count_if("abstained").alias("abstained_observation_count"), F.count("*").alias("assigned"))
    out = t
    for part in (o, a, g, c, conflict, hit, over, cover, done, ambiguous):
        out = out.join(part, keys, "left")
    out = out.na.fill(0, ["over", "complete_chain_count", "ambiguous_event_count", "ambiguous_group_count", "detected_ambiguous_group_count", "tp"])
    col = F.col
    correct = (col("inner") - col("over")).alias("correct_join_count")
    out = out.select("*", correct).drop("inner", "over")
    share = lambda x, y: F.try_divide(col(x), col(y))
    out = out.select(
        *keys,
        "truth_chain_count",
        "canonical_event_count",
        "observation_count",
        "predicted_group_count",
        "predicted_chain_group_count",
        "complete_chain_count",
        share("complete_chain_count", "truth_chain_count").alias("exact_chain_accuracy"),
        share("complete_chain_count", "predicted_chain_group_count").alias("exact_chain_precision"),
        "mean_chain_member_coverage",
        "true_join_pair_count",
        "predicted_join_pair_count",
        "correct_join_count",
        (col("true_join_pair_count") - col("correct_join_count")).alias("missed_join_count"),
        (col("predicted_join_pair_count") - col("correct_join_count")).alias("false_join_count"),
        F.coalesce(share("correct_join_count", "predicted_join_pair_count"), F.lit(1.0)).alias("join_precision"),
        F.coalesce(share("correct_join_count", "true_join_pair_count"), F.lit(1.0)).alias("join_recall"),
        "ambiguous_group_count",
        "ambiguous_event_count",
        share("ambiguous_event_count", "canonical_event_count").alias("ambiguous_event_rate"),
        "accepted_ambiguous_group_count",
        "detected_ambiguous_group_count",
        col("tp").alias("ambiguity_detection_true_positive"),
        (col("detected_ambiguous_group_count") - col("tp")).alias("ambiguity_detection_false_positive"),
        (col("ambiguous_group_count") - col("tp")).alias("ambiguity_detection_false_negative"),
        share("tp", "detected_ambiguous_group_count").alias("ambiguity_detection_precision"),
        share("tp", "ambiguous_group_count").alias("ambiguity_detection_recall"),
        "source_conflict_group_count",
        "detected_source_conflict_group_count",
        share("ctp", "detected_source_conflict_group_count").alias("source_conflict_detection_precision"),
        share("ctp", "source_conflict_group_count").alias("source_conflict_detection_recall"),
        "abstained_observation_count",
        share("abstained_observation_count", "observation_count").alias("abstention_rate"),
        (col("observation_count") - col("assigned")).alias("deduplicated_observation_count"),
        F.try_divide(col("observation_count") - col("assigned"), col("observation_count")).alias("deduplication_rate"),
        col("complete_chain_count").alias("time_to_completeness_observations"),
        "time_to_completeness_p50_ms",
        "time_to_completeness_p95_ms",
        "time_to_completeness_max_ms",
    )
    p, r = col("exact_chain_precision"), col("exact_chain_accuracy")
    more = {
        "event_count": col("canonical_event_count"),
        "complete_chain_coverage": r,
        "exact_chain_recall": r,
        "exact_chain_f1": F.when(p.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))),
        "missed_join_rate": share("missed_join_count", "true_join_pair_count"),
        "false_join_rate": F.coalesce(share("false_join_count", "predicted_join_pair_count"), F.lit(0.0)),
    }
    return out.withColumns(more)


def summarize(metrics: DataFrame, by: tuple[str, ...], names: list[str]) -> DataFrame:
    """(by.., metric, trials, min, q1, median, q3, max): linear-interpolated quartiles; null values don't count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")
    rows = metrics.select(*by, pairs).select(*by, "m.metric", "m.value")
    q = lambda p: F.percentile("value", p)
    return rows.groupBy(*by, "metric").agg(F.count("*").alias("trials"), F.min("value").alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("value").alias("max"))
