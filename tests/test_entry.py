"""The driver's contract: every query runs, and matches its SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from annolith import more_queries, queries

QUERIES = queries.QUERIES | more_queries.QUERIES
ORACLES = queries.ORACLES | more_queries.ORACLES

duckdb = pytest.importorskip("duckdb")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name in ORACLES:
        con = duckdb.connect()
        for t in os.listdir(sf_dir):
            con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
        want = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
