"""Every registered query with SQL gives the SQL's rows, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PAIRS = __spark_entry__.oracle_sql()


def rows(df: pd.DataFrame) -> list[str]:
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        return None if v is None or v is pd.NaT or v != v else v

    return sorted(str([one(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_equals_sql(spark, small, duck, name):
    got = __spark_entry__.queries()[name](spark, small).toPandas()
    want = duck.execute(PAIRS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query_and_entry_runs(spark):
    assert set(PAIRS) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
