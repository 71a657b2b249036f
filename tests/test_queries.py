"""Every registered query runs; those with SQL agree with DuckDB."""

import pytest

import __spark_entry__ as contract
from tests.helpers import normal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_agrees_with_sql(spark, data, duck, name):
    made = QUERIES[name](spark, data).toPandas()
    wanted = duck.execute(SQL[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert normal(made) == normal(wanted)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline"))
def test_runs_without_sql(spark, data, name):
    """The text operators have tests of their own."""
    assert QUERIES[name](spark, data).count() > 0


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, data):
    out = contract.entry(spark)
    assert out.columns == ["series_id", "rows", "mae", "r2", "csi"]
    assert out.count() > 0
