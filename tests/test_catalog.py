"""Every query of the catalogue against the same query in DuckDB: names, types and rows, in any order."""

import datetime
import math
import os

import duckdb
import pytest

from brindle.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
KINDS = {"SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, datetime.date) else v


def multiset(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    kinds = [KINDS.get(str(x[1]), str(x[1])) for x in want.description]
    assert sorted(found.columns) == sorted(columns)
    found = found.select(*columns)
    assert [k for _, k in found.dtypes] == kinds
    assert multiset(found.collect()) == multiset(want.fetchall())
