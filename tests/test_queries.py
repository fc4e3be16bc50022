"""Every query against its SQL on the smallest tables, and the contract's shape."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracewright.plans import catalog
from tracewright.sources import files


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    expected = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    own = sorted(str([r[c] for c in columns]) for r in df.collect())
    assert own == sorted(str([dict(zip(expected.columns, r))[c] for c in columns]) for r in expected.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_listing(spark, sf_dir):
    assert files.list_files(spark, sf_dir, extensions=("parquet",)).count() == len(glob.glob(f"{sf_dir}/*.parquet"))
