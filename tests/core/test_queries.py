"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from veriflux.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, con, name):
    df, out = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(out.columns)
    a = sorted((str([plain(r[c]) for c in columns]) for r in df.collect()))
    b = sorted((str([plain(dict(zip(out.columns, r))[c]) for c in columns]) for r in out.fetchall()))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_give_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
