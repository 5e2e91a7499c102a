"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import pytest

from candela.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)
    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    whole = [c for c in got.columns if got[c].dtype.kind in "iu" or want[c].dtype.kind in "iuf"]
    for c in whole:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)
