from __future__ import annotations

import ast
from collections import Counter

import corpus_pipeline
from evidentia.llm.shared import stored

from .test_jaccard_join import brute


def test_each_stage_on_all_that_the_one_before_kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out, _ = stored(spark, stage(spark, seen[-1], small), "stage")
        seen.append(out)
    clean, single, mix, pieces = seen[1:]
    assert clean.columns == single.columns == mix.columns == columns
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in seen]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and set(ids[3]) <= set(ids[2]) and max(ids[3].values()) <= 2
    assert set(ids[4]) == set(ids[3])
    # by comparing all pairs: of each group that links connect the smallest id stays, and nothing else goes
    was = sorted((k, texts[k]) for k in ids[1])
    least = {k: c for k, _, c in components(was, 5, 80, 100)}
    assert set(ids[2]) == {k for k, _ in was if least[k] == k} and 0 < len(ids[2]) < len(ids[1])


def components(rows, words, num, den):
    return [ast.literal_eval(x) for x in brute(rows, words, num, den)]


def test_odd_rows(spark, odd, none):
    twice = odd.unionByName(odd.where("doc_id = 8"))
    out = corpus_pipeline.without_near_duplicates(spark, twice, "")
    assert out.columns == odd.columns and 0 < out.count() < odd.count()
    assert sum(not (r.text or "").split() for r in out.collect()) == 3
    # which one stays depends neither on the order of rows nor on keys that repeat elsewhere
    again = corpus_pipeline.without_near_duplicates(spark, twice.repartition(5).orderBy("n_chars"), "")
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(5) == kept.count(8) == 1 and not {6, 9, 90, None} & set(kept)
    assert corpus_pipeline.without_near_duplicates(spark, none, "").count() == 0
    assert corpus_pipeline.mixed(spark, none, "").count() == 0
