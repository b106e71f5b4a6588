"""Each query against its SQL on the smallest tables; skipped where the tables are absent."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, kind, normal

FOLDER = entry.SMOKE
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, db, name):
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = normal(columns, result.fetchall())
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert {c: kind(k) for c, k in df.dtypes} == {d[0]: kind(str(d[1])) for d in result.description}
    assert normal(df.columns, df.collect()) == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"l_shipdate_weekday_sin", "l_returnflag_A"} <= set(df.columns)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(entry.queries())
