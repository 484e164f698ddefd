"""Registered queries against their SQL, run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as driver

SQL_CHECKED = sorted(driver.ORACLE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, int) else str(v)


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    names = sorted(df.columns)
    cur = duck.execute(driver.oracle_sql()[name])
    sql_names = [d[0] for d in cur.description]
    assert sorted(sql_names) == names
    want = ordered([tuple(cell(r[sql_names.index(c)]) for c in names) for r in cur.fetchall()])
    got = ordered([tuple(cell(r[c]) for c in names) for r in df.collect()])
    assert got == want and (got or name == "missed_insiders")


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(driver.QUERIES) - set(driver.ORACLE) == {
        "weight_search", "iforest_scores", "iforest_embeddings", "recon_scores", "window_network_scores"}


def test_entry(spark):
    df = driver.entry(spark)
    assert "explanation" in df.columns and df.count() > 0
