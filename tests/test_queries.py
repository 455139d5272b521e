"""Every registered archive query against its SQL on the smallest tables."""

import duckdb
import pytest

from aktarium.plans import archive_queries as aq

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr([clean(r[k]) for k in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(aq.ORACLES))
def test_query_equals_sql(spark, tiny, duck, name):
    df = aq.QUERIES[name](spark, tiny)
    want = duck.sql(aq.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(aq.QUERIES) - set(aq.ORACLES)))
def test_query_without_sql_runs(spark, tiny, name):
    assert aq.QUERIES[name](spark, tiny).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(aq.QUERIES) <= set(__spark_entry__.queries())
