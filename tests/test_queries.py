"""All queries against their check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from encaje.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Slow to fit; two of the forest queries stand for the others.
SLOW = {"train_forest_batched", "score_forest", "model_roundtrip"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if x != x or x is None else float(x) if isinstance(x, (int, float))
                         and not isinstance(x, bool) else x for x in r)
                   for r in df.itertuples(index=False)), key=repr)


def test_every_query_has_check_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert len(got) > 0 and sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
