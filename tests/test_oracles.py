"""Every query outside the llm subpackage against its SQL on DuckDB, over whole tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from postgrain.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    return tuple(map(plain, x)) if isinstance(x, list) else x


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([list(r) for r in df.collect()], df.columns) == rows(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
