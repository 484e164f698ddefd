"""Corpus queries against their SQL, run by DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as driver
from wardlight.llm.oracle import ORACLE


def cell(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = driver.queries()[name](spark, SF_DIR)
    names = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    sql = [d[0] for d in cur.description]
    assert sorted(sql) == names
    want = sorted((tuple(cell(r[sql.index(c)]) for c in names) for r in cur.fetchall()), key=str)
    got = sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == want and got
