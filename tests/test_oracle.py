"""Every query with SQL against DuckDB, at the smallest size."""

import duckdb
import pytest

from tidelog.plans import catalog, stored  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    assert {c: TYPES[k] for c, k in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())



def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
