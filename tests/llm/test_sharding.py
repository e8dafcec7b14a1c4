from __future__ import annotations

import pytest
from evidentia.llm.shared import scratch
from evidentia.llm.sharding import FACTOR, ShardedTable
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(str, df.collect()))


def test_versions_merge_and_keep_every_row(spark, odd):
    table = ShardedTable(spark, scratch(spark, "t"), target_bytes=400_000)
    assert table.version() == 0
    for i in range(3):
        table.append(odd.withColumn("batch", F.lit(i)), rows=5)
    before = table.manifest()
    assert table.version() == 3 and len(before["shards"]) >= FACTOR
    after = table.compact()
    assert after == 4 and len(table.manifest()["shards"]) < len(before["shards"])
    want = odd.withColumn("batch", F.lit(0))
    for i in (1, 2):
        want = want.unionByName(odd.withColumn("batch", F.lit(i)))
    assert rows(table.read()) == rows(want)
    assert rows(table.read(3)) == rows(want)  # an older version keeps its files
    assert table.read(1).count() == odd.count()
    assert table.compact() == after  # nothing left to merge


def test_of_two_writers_one_fails(spark, odd):
    table = ShardedTable(spark, scratch(spark, "t"))
    table.append(odd)
    now = table.manifest()
    with pytest.raises(Exception, match="(?i)exist"):
        table._commit(1, odd.schema.json(), now["shards"])
    assert table.version() == 1 and table.read().count() == odd.count()


def test_empty(spark, none):
    table = ShardedTable(spark, scratch(spark, "t"))
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.append(none) == 1
    assert table.read().count() == 0 and table.read().columns == none.columns
    assert table.compact() == 1


def test_what_a_lost_job_wrote_neither_blocks_nor_slips_in(spark, odd, monkeypatch):
    table = ShardedTable(spark, scratch(spark, "t"))
    monkeypatch.setattr(ShardedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.append(odd)
    monkeypatch.undo()
    assert table.append(odd) == 1 and rows(table.read()) == rows(odd)


def test_merged_runs_merge_again(spark, odd):
    table = ShardedTable(spark, scratch(spark, "t"), target_bytes=1 << 30)
    for _ in range(2 * FACTOR):
        table.append(odd.coalesce(1), rows=10**6)
    table.compact()
    shards = table.manifest()["shards"]
    tiers = [s.tier for s in shards]
    assert all(tiers.count(t) < FACTOR for t in tiers) and table.read().count() == 2 * FACTOR * odd.count()
