from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from evidentia.llm import toxicity


def corpus(n, seed):
    """Toxic documents hold words of one stem; clean ones never do."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ko", "li", "mu", "ste", "ron"]) for _ in range(3))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vrak" + word())
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(corpus(400, 1))


def test_held_out_accuracy_and_spans(spark, model):
    rows = [(i, x, y) for i, (x, y) in enumerate(corpus(300, 2))]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, y int"), model).collect()}
    assert all((got[i].score >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows)
    for i, x, y in rows:
        assert {x[s.start : s.end][:4] for s in got[i].spans} == ({"vrak"} if y else set())


def test_marginals_equal_all_labellings(model):
    words = ["bako", "vrakbako", "li", "limu", "vrakronli", "ste", "ste"]
    def weight(y):
        s = sum(model.bias + model.weight(w) for w, v in zip(words, y, strict=True) if v)
        return math.exp(s + sum(model.steps[a][b] - model.steps.max() for a, b in itertools.pairwise(y)))
    every = {y: weight(y) for y in itertools.product((0, 1), repeat=len(words))}
    for i, p in model.marginals(words):
        assert p == pytest.approx(sum(w for y, w in every.items() if y[i]) / sum(every.values()), abs=1e-9)
    far = ["bako"] * 3 + ["vrakbako"] + ["bako"] * 200 + ["vrakmu"] + ["bako"] * 3
    assert all(0 <= p <= 1 for _, p in model.marginals(far)) and np.isfinite(model.document(model.marginals(far), len(far)))


def test_odd_rows(spark, odd, none, model):
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score < 0.5 and not r.spans for r in got)
    assert sorted(map(str, toxicity.without_toxic(odd, model).collect())) == sorted(map(str, odd.collect()))
    assert toxicity.without_toxic(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (999, 1), (3, 0)], "doc_id long, toxic int")
    trained = toxicity.train(spark, odd, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, trained).collect())
    assert toxicity.score_toxicity(odd, toxicity.train(spark, odd, labels.limit(0))).agg({"score": "max"}).first()[0] < 1e-6


def test_spans_point_into_the_text_itself(spark, model):
    text = "İİ BAKO Vrakbako li. İ VRAKMU ste"
    found = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().spans
    assert [text[s.start : s.end] for s in found] == ["Vrakbako", "VRAKMU"]


def test_near_copies_count_once():
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    letters = str.maketrans("0123456789", "abcdefghij")
    copies = [(" ".join([*base[:i], f"x{i}", *base[i + 1 :]]).translate(letters), 1) for i in range(20)]
    other = [(" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)).translate(letters), 1) for _ in range(5)]
    assert len(toxicity._Sample(copies + other).groups()) == 6
    assert toxicity._selected(toxicity._Sample(copies + [(x, 0) for x, _ in other])) == []


def test_held_out_labels(spark):
    """Fitted on the learning fold of sf0.01, the held-out labels tell how well it does."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.train(spark, docs, labels), spans=False)
    rows = scored.join(labels.where(toxicity.remainder("doc_id") == 1).where("toxic in (0, 1)"), "doc_id").collect()
    toxic, clean = ([r.score >= toxicity.THRESHOLD for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) >= 10 and sum(toxic) / len(toxic) >= 0.75
    assert sum(clean) / len(clean) <= 0.02
