"""Each query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lexispark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(spark_rows, names, found, duck_names):
    assert sorted(names) == sorted(duck_names)
    a, b = ([i for _, i in sorted((n, i) for i, n in enumerate(x))] for x in (names, duck_names))
    assert sorted(repr([r[i] for i in a]) for r in spark_rows) == sorted(repr([r[i] for i in b]) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cur = duck.execute(registry.oracle_sql()[name])
    same(df.collect(), df.columns, cur.fetchall(), [c[0] for c in cur.description])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, name):
    """Queries that SQL can't express: tests/test_training.py and tests/test_extensions.py hold what they call against brute force."""
    assert registry.queries()[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert registry.entry(spark, DATA).count() > 0
