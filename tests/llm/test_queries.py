"""Queries of the subpackage: those with SQL against it, all of them for their columns."""

import os

import duckdb
import pytest

from postgrain.llm import queries

COLUMNS = {
    "p1_found": ["posting_key", "description_capture_id", "url_capture_id", "channel_capture_id"], "p2_found": ["job_id_a", "job_id_b"], "p3_found": ["job_id", "listing_id"],
    "p6_found": ["field", "row_id", "ref_key"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "reading_level"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, data).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name] and df.count() > 0 and df.count() == df.distinct().count()
