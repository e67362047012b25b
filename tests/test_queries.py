"""Every query with SQL over the smallest tables, against DuckDB; the others must run and keep a stable schema."""

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _names():
    import __spark_entry__ as entry
    from tidemark.plans import ledger, problems, reports

    return [n for plan in (problems, ledger, reports) for n in plan.QUERIES if n in entry.oracle_sql()]


@pytest.mark.parametrize("name", _names())
def test_same_rows_as_sql(spark, con, name):
    import __spark_entry__ as entry
    from oracle import rows

    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pandas(date_as_object=True)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["table_name", "event_id"]


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
