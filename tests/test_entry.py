"""Every query against its SQL on the small tables, where they are there."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidewheel.plans import queries as own

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_and_sql(spark, con, name):
    df = own.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.sql(own.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = lambda x: sorted((plain(r) for r in x), key=lambda r: [(v is None, str(v)) for v in r])
    assert rows(df.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
