from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from evidentia.llm import mixing, shared
from pyspark.sql import functions as F


def test_targets_share_weight_and_excess():
    got = mixing.allot([("b", 100), (None, 100), ("a", 10), ("c", 1000)])
    total, weights, most = 1.5 * 1210, {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 20, "b": 200, "c": 2000, None: 200}
    assert sum(got.values()) == pytest.approx(total) and all(got[s] <= most[s] + 1e-9 for s in got)
    free = [s for s in got if got[s] < most[s] - 1e-9]
    assert len({round(got[s] / weights[s], 6) for s in free}) <= 1
    assert all(got[s] / weights[s] <= got[f] / weights[f] + 1e-9 for s in got for f in free)
    assert mixing.allot([]) == {} and mixing.allot([("a", 0)]) == {"a": 0.0}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    size, pi = rng.integers(1, 5000, 700), np.full(700, 0.37)
    after = mixing.flight(pi, size, rng)
    assert ((after > 1e-9) & (after < 1 - 1e-9)).sum() <= 2
    assert after.sum() == pytest.approx(pi.sum()) and (after * size).sum() == pytest.approx((pi * size).sum())
    drawn = np.mean([mixing.flight(pi[:30], size[:30], np.random.default_rng(i)) for i in range(2000)], axis=0)
    assert np.abs(drawn - 0.37).max() < 0.06  # each row keeps its probability in the mean
    landed = mixing.land(after, size)
    assert set(landed) <= {0.0, 1.0}


def test_targets_are_met_and_reruns_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.mix_sources(spark, docs).collect()
    again = mixing.mix_sources(spark, docs.repartition(9)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 20 for s in target)


def test_odd_rows(spark, odd, none):
    got = mixing.mix_sources(spark, odd).collect()
    assert len(got) == odd.count() and sum(r.size == 0 for r in got) == 3
    assert {r.source for r in got} == {"src0", "src1", "src2", None}
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    mixed = mixing.mixed(spark, odd)
    assert mixed.columns == odd.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert mixing.mix_sources(spark, none).count() == 0 and mixing.mixed(spark, none).count() == 0


def test_rows_are_taken_as_often_as_picked(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))
    copies = Counter()
    for r in mixing.mix_sources(spark, docs).collect():
        copies[r.doc_id, r.source] += r.copies
    want = {k: n for k, n in copies.items() if n}
    assert len(want) < len(copies) and len(set(want.values())) > 1
    # also where the filter lets everything through
    for blocks in (1 << 17, 1):
        monkeypatch.setattr(shared, "FILTER_BLOCKS", blocks)
        assert Counter((r.doc_id, r.source) for r in mixing.mixed(spark, docs).collect()) == want


def test_filter_parts_rows(spark, monkeypatch):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    df = spark.range(3000).withColumn("h", F.lit("clash")).unionByName(spark.createDataFrame([(None, "x")], "id long, h string"))
    for blocks in (1 << 17, 64, 1):
        monkeypatch.setattr(shared, "FILTER_BLOCKS", blocks)
        sure, others = ([r.id for r in x.collect()] for x in shared.apart(df, F.xxhash64("id"), keys))
        assert Counter(sure + others) == Counter([*range(3000), None])
        assert not any(i is not None and i % 3 == 0 for i in sure)
        assert blocks == 1 or len(others) < 1000 + 2000 * (blocks == 64) + 20
    sure, others = shared.apart(df, F.xxhash64("id"), keys.limit(0))
    assert (sure.count(), others.count()) == (3001, 0)
