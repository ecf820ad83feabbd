"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def rows(data, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in places) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, sf_dir, oracle):
    got = entry.queries()[name](spark, sf_dir)
    data = got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    want = oracle.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(data, got.columns) == rows(want.fetchall(), columns)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["key", "type", "ts", "oos_hours"]
