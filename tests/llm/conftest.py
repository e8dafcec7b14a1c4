from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, key long, label string, node string"


def _rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; further columns with clashing names."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) + "." for _ in range(40)]
    texts = [None, "", " \n\t ", "x", "one two", prose[0], prose[0], "\n".join(prose) * 40, "ñandú \U0001f600 ÉTÉ end", *prose]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "h", 1, "l", "n") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, prose[3], None, None, None, None, None, None, None), (90, prose[4], None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd_unique(odd):
    return odd.where("doc_id is not null").dropDuplicates(["doc_id"])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
