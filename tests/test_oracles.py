"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from scoreloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(spark, duck, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert not [d for d in result.description if "HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1])]
    assert got == sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_query_is_known_by_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3
