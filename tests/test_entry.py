import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
CORE = [n for n in entry.registry.queries()]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(TABLES):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twins(spark, duck, name):
    df = entry.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(CORE) - set(entry.oracle_sql())))
def test_queries_without_twin_run(spark, name):
    assert entry.queries()[name](spark, TABLES).count() > 0 or name == "unindexed_reason"  # all of the smallest size's forms have elements


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
