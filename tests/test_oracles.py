"""Every core query against its SQL, on the driver's smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from brindle.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    return round(float(x), 6) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_sql_gives(spark, con, name):
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    rows = [tuple(cell(r[c]) for c in columns) for r in got.collect()]
    theirs = [tuple(cell(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    rows, theirs = sorted(rows, key=key), sorted(theirs, key=key)
    assert len(rows) == len(theirs)
    assert rows == theirs


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
