"""Every registered query runs; those with an oracle give DuckDB's rows."""

import os

import duckdb
import pandas as pd
import pytest

from millrace.plans import corpus_queries, rollout_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = {**rollout_queries.QUERIES, **corpus_queries.QUERIES}
SQL = {**rollout_queries.ORACLES, **corpus_queries.ORACLES}

@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(plain, v))
    return None if v is None or v is pd.NA or v != v else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    got = ALL[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_registry():
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
