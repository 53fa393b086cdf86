"""Every registered query against its SQL, on the smallest data set."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables absent")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert ours, "no rows"
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(row[i]) for i in order) for row in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() > 0
