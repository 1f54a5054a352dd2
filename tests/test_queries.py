"""Every registered query against its SQL, at the smallest scale; and those without SQL for a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(frame):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return ""
        return f"{x:.6g}" if isinstance(x, float) else f"{float(x):.6g}" if isinstance(x, (int, bool)) or type(x).__module__ == "numpy" and str(x).replace(".", "").replace("-", "").isdigit() else str(x)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert df.columns == catalog.queries()[name](spark, sf_dir).columns
    df.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["g12_co_retrieved", "j18_runs_behind", "v14_fleet"])
def test_queries_filter_no_ids(name):
    sql = catalog.oracle_sql()[name]
    assert "% 10 = 0" not in sql and "% 40 = 0" not in sql and sql == catalog.oracle_sql()[f"{name}_whole"]
