"""What reaches the driver, and rules that hold at every size."""

from __future__ import annotations

from evidentia.llm import jaccard_join as jj
from evidentia.llm import licenses, suffix_tree
from pyspark.sql import functions as F


def test_the_filter_reaches_the_driver_in_pages(spark, monkeypatch):
    texts = spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("a b c d "), "id").alias("text"))
    shingler = jj.Shingler(3)
    nodes = [jj.node_of(shingler.tokens(f"a b c d {i}".encode())) for i in range(400)]
    rows = spark.createDataFrame([(i, 3, n, b"\0" * 8) for i, n in enumerate(nodes)], "key long, n long, node long, bits binary")
    verify = jj._Verifier(spark, texts, rows, 3, 90, 100)
    seen = []
    for way in ("toPandas", "collect", "toArrow", "toLocalIterator"):
        own = getattr(type(rows), way)
        monkeypatch.setattr(type(rows), way, lambda df, *a, own=own, **k: seen.append(df.columns) or own(df, *a, **k))
    sets, _ = verify.sets(spark.createDataFrame([(n,) for n in nodes[::2]], "node long"))
    assert seen == [["page", "bits"]]
    assert set(nodes[::2]) <= {r.node for r in sets.collect()}
    assert sets.count() < 250


def test_licenses_cut_the_words_of_a_text_once(spark):
    """The whole text's words are its lines' words, and a long text of few kinds of words is still a unit."""
    notice = "Released under the MIT License."
    texts = ["\n".join(["released under", "the mit license"] * 40), " ".join([notice] * 30), notice + "\n" + " ".join(f"w{i}" for i in range(500)), "a\nb"]
    out = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: (r.best_license, round(r.best_dice, 6), r.n_units) for r in out.collect()}
    assert got == {0: ("MIT", round(8 / 9, 6), 1), 1: ("MIT", round(8 / 9, 6), 1), 2: ("MIT", 1.0, 1), 3: (None, 0.0, 0)}
    assert "array_join" not in out._jdf.queryExecution().analyzed().toString()


def test_one_rule_chooses_the_n_grams_at_every_size():
    """No size has a rule of its own: the count rises throughout, and so does the number of n-grams it allows."""
    tokens = [10**e for e in range(3, 13)]
    counts = [suffix_tree.least(t) for t in tokens]
    assert counts == sorted(set(counts))
    assert [t / n for t, n in zip(tokens, counts, strict=True)] == sorted(t / n for t, n in zip(tokens, counts, strict=True))
