"""Every registered query against its SQL twin on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from livetick.plans import catalog

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(catalog.queries()) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    got = normal(df.columns, df.collect())
    rel = duck.sql(SQL[name])
    want = normal(rel.columns, rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
