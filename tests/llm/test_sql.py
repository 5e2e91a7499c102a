"""The corpus queries that SQL can express, against DuckDB on the small tables."""

import glob
import os

import pytest

from candela.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda frame: sorted(map(tuple, frame[sorted(frame.columns)].itertuples(index=False)))
    assert rows(got) == rows(want) and len(got)
