"""Queries of the text operators against their SQL, all rows."""

import duckdb
import pytest

from relaygauge.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = connection.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    frame = QUERIES[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(cursor.fetchall())
