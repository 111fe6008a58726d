"""The driver contract: every query runs, and those with SQL equal it (smallest tables)."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    result = queries()[name](spark, FOLDER)
    mine = pd.DataFrame([r.asDict() for r in result.collect()], columns=result.columns, dtype=object)
    assert len(mine) > 0
    if name in oracle_sql():
        cursor = duck.execute(oracle_sql()[name])
        theirs = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows_of(mine) == rows_of(theirs)
