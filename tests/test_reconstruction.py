"""Policies, faults and scores against the published values and small cases."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from evidentia.functions.hashing import fraction, modulo, odd, seeded
from evidentia.operators import faults, observe, reconstruct, score
from evidentia.plans import reconstruction
from evidentia.plans.reconstruction import campaign_summary, campaign_trials
from evidentia.sources import synthetic
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def medians(spark):
    """Medians over the published seeds, one scenario and policy at a time."""
    known: dict = {}

    def of(scenario: str, policy: str) -> dict:
        if (scenario, policy) not in known:
            spec = next(s for s in faults.scenarios() if s["name"] == scenario)
            rows = campaign_summary(spark, synthetic.SEEDS, 600, 24, [spec], (policy,)).collect()
            known[scenario, policy] = {r.metric: r.median for r in rows}
        return known[scenario, policy]

    return of


#: Published medians of thirty seeds, in per cent.
PUBLISHED = [
    ("wrong_id_same_service_5pct", "strict_service_plus_correlation", "exact_chain_accuracy", 54.25),
    ("wrong_id_same_service_5pct", "strict_service_plus_correlation", "exact_chain_f1", 62.13),
    ("wrong_id_same_service_5pct", "strict_service_plus_correlation", "abstention_rate", 29.47),
    ("wrong_id_same_service_5pct", "strict_service_plus_correlation", "join_recall", 66.99),
    ("collision_cross_service_5pct", "correlation_id_only_ablation", "exact_chain_accuracy", 90.00),
    ("collision_cross_service_5pct", "correlation_id_only_ablation", "false_join_rate", 10.71),
    ("duplicate_source_conflict_5pct", "strict_service_plus_correlation", "exact_chain_accuracy", 73.42),
    ("duplicate_source_conflict_5pct", "strict_service_plus_correlation", "abstention_rate", 9.52),
    ("control", "naive_temporal_window", "exact_chain_accuracy", 75.33),
    ("control", "naive_temporal_window", "join_recall", 92.60),
    ("control", "naive_temporal_window", "false_join_rate", 13.78),
    ("compound_adversarial", "strict_service_plus_correlation", "exact_chain_accuracy", 47.33),
    ("compound_adversarial", "strict_service_plus_correlation", "exact_chain_f1", 49.82),
    ("compound_adversarial", "strict_service_plus_correlation", "abstention_rate", 19.01),
    ("compound_adversarial", "strict_service_plus_correlation", "join_recall", 72.86),
]


@pytest.mark.parametrize(("scenario", "policy", "metric", "percent"), PUBLISHED)
def test_published_medians(medians, scenario, policy, metric, percent):
    assert round(100 * medians(scenario, policy)[metric], 2) == pytest.approx(percent, abs=0.0101)


def test_published_times(medians):
    assert medians("control", "naive_temporal_window")["time_to_completeness_p95_ms"] == 1275
    assert medians("collision_cross_service_5pct", "correlation_id_only_ablation")["accepted_ambiguous_group_count"] == 30


def test_hash_helpers(spark):
    import hashlib

    row = spark.range(1).select(seeded(F.lit(7), "a", F.lit("b")).alias("h")).select("h", fraction(F.col("h")).alias("f"), modulo(F.col("h"), 3001).alias("m"), odd(F.col("h")).alias("o")).first()
    n = int.from_bytes(hashlib.sha256(b"7\x1fa\x1fb").digest(), "big")
    assert row.f == pytest.approx(n / 2**256, abs=1e-15) and row.m == n % 3001 and row.o == bool(n % 2)


def small(spark, rows):
    return spark.createDataFrame([(e, s, t, h, v, ms, c) for e, s, t, h, v, ms, c in rows], "event_id string, source_id string, source_type string, payload_hash string, service string, source_ms long, correlation_id string")


def test_replays_and_conflicts(spark):
    df = small(spark, [("b", "1", "x", "h", "s", 1, "c"), ("a", "1", "x", "h", "s", 1, "c"), ("c", "2", "x", "h", "s", 1, "c"), ("d", "2", "x", "k", "s", 1, "c")])
    got = {r.event_id: (r.replayed, r.conflict) for r in observe.prepared(df).collect()}
    assert got == {"a": (False, False), "b": (True, False), "c": (False, True), "d": (False, True)}
    assert [(r.source_id, r.payloads) for r in observe.conflicts(df).collect()] == [("2", 2)]


def test_policies_on_odd_input(spark):
    df = small(spark, [])
    for policy in reconstruct.POLICIES.values():
        assert policy(df).count() == 0
    df = small(spark, [("a", "1", "deployment", "h", "s", 0, None), ("b", "2", "policy", "h", "s", 5000, "c"), ("d", "3", "policy", "h", "s", 5100, "c")])
    got = {r.event_id: (r.group_id, r.abstained) for r in reconstruct.strict(df).collect()}
    assert got == {"a": ("strict:missing-id:a", True), "b": ("strict:ambiguous:b", True), "d": ("strict:ambiguous:d", True)}


def test_episodes_never_move_their_anchor(spark):
    rng = random.Random(4)
    times = [(f"e{i:04d}", rng.choice("xy"), rng.randrange(60_000)) for i in range(400)]
    df = spark.createDataFrame(times, "event_id string, service string, source_ms long")
    want, state = {}, {}
    for e, s, t in sorted(times, key=lambda r: (r[2], r[0])):
        anchor, n = state.get(s, (None, -1))
        if anchor is None or t - anchor > 1500:
            anchor, n = t, n + 1
        state[s] = anchor, n
        want[e] = n
    assert {r.event_id: r.episode for r in reconstruct.episodes(df, ["service"], 1500).collect()} == want


@pytest.mark.parametrize(("scenario", "name"), [("duplicate_source_conflict_5pct", "correlation_id_only_ablation"), ("compound_adversarial", "naive_temporal_window")])
def test_scores_against_pairs(spark, scenario, name):
    spec = next(s for s in faults.scenarios() if s["name"] == scenario)
    events = faults.campaign(synthetic.observations(spark, 48, 4, (11,)), [spec]).persist()
    rows = {r.event_id: r for r in events.collect()}
    groups = {}
    for r in reconstruct.POLICIES[name](events, by=("seed", "scenario"), start=reconstruct.cadence()).collect():
        groups.setdefault(r.group_id, []).append(rows[r.event_id])
    predicted = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    pair = lambda a, b: tuple(sorted((a.canonical_event_id, b.canonical_event_id)))
    correct = {pair(a, b) for g in groups.values() for a, b in combinations(g, 2) if a.truth_chain_id == b.truth_chain_id and a.canonical_event_id != b.canonical_event_id}
    got = campaign_trials(spark, (11,), 48, 4, [spec], (name,)).first()
    assert (got.predicted_join_pair_count, got.correct_join_count) == (predicted, len(correct))


def test_inversions(spark, monkeypatch):
    monkeypatch.setattr(score, "BUCKET_ROWS", 20)
    rng = random.Random(8)
    rows = [("g", f"e{i:03d}", rng.randrange(20_000)) for i in range(300)]
    rows = [(g, e, s, s + rng.randrange(3001)) for g, e, s in rows]
    want = sum((a[2], a[1]) < (b[2], b[1]) and (a[3], a[1]) > (b[3], b[1]) for a in rows for b in rows)
    df = spark.createDataFrame(rows, "g string, event_id string, truth_source_ms long, arrival_ms long")
    assert score.arrival_inversions(df, ("g",), 3001).first().inversions == want


#: Further published medians of thirty seeds, in per cent.
ALSO_PUBLISHED = [
    ("control", "exact_chain_accuracy", 100.00),
    ("missing_random_5pct", "exact_chain_accuracy", 73.25),
    ("missing_random_5pct", "missed_join_rate", 9.77),
    ("missing_plane_policy", "abstention_rate", 16.67),
    ("missing_plane_policy", "join_recall", 66.67),
    ("collision_same_service_5pct", "exact_chain_accuracy", 90.00),
    ("collision_cross_service_5pct", "exact_chain_accuracy", 100.00),
    ("duplicate_exact_10pct", "deduplication_rate", 9.09),
    ("clock_skew_random_10pct_5s", "exact_chain_accuracy", 53.00),
    ("clock_skew_random_10pct_5s", "abstention_rate", 47.00),
]


@pytest.mark.parametrize(("scenario", "metric", "percent"), ALSO_PUBLISHED)
def test_further_published_medians(medians, scenario, metric, percent):
    assert round(100 * medians(scenario, "strict_service_plus_correlation")[metric], 2) == pytest.approx(percent, abs=0.0101)


def test_published_strict_times(medians):
    assert medians("control", "strict_service_plus_correlation")["time_to_completeness_p95_ms"] == 1275
    assert medians("late_arrival_10pct_30s", "strict_service_plus_correlation")["time_to_completeness_p95_ms"] == 31_275


REST = [(s, p) for s in ("duplicate_source_conflict_5pct", "compound_adversarial") for p in reconstruct.POLICIES if (s, p) not in (("duplicate_source_conflict_5pct", "correlation_id_only_ablation"), ("compound_adversarial", "naive_temporal_window"))]


@pytest.mark.parametrize(("scenario", "name"), REST)
def test_scores_against_pairs_of_the_rest(spark, scenario, name):
    test_scores_against_pairs(spark, scenario, name)


def test_the_registered_campaign_is_whole(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(reconstruction, "campaign_summary", lambda spark, seeds, chains, services, specs=None, policies=tuple(reconstruct.POLICIES): asked.append((seeds, chains, services, specs or faults.scenarios(), policies)))
    reconstruction.robustness_campaign(spark, "")
    assert asked == [(synthetic.SEEDS, 600, 24, faults.scenarios(), tuple(reconstruct.POLICIES))]
    assert (len(synthetic.SEEDS), len(faults.scenarios()), len(reconstruct.POLICIES)) == (30, 25, 3)
