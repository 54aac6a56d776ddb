"""Every catalogue query against its SQL on the smallest tables."""

import datetime
import os

import pytest

from folioforge.plans import files, files_more  # noqa: F401  register their queries
from folioforge.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if isinstance(value, datetime.datetime) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    other = sql.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    a = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [other.columns.index(c) for c in columns]
    assert a == ordered(tuple(plain(r[k]) for k in at) for r in other.fetchall())


def test_as_of_needs_no_join(spark):
    plan = QUERIES["label_ranges_asof"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
