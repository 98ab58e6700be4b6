"""Every query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from trialspan.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 7))
    return str(v)


def rows(values, order):
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    found = [tuple(r) for r in got.collect()]
    if name not in catalogue.oracle_sql():
        assert got.columns
        return
    relation = duck.sql(catalogue.oracle_sql()[name])
    names = relation.columns
    assert sorted(got.columns) == sorted(names)
    assert rows(found, [got.columns.index(c) for c in sorted(names)]) == rows(relation.fetchall(), [names.index(c) for c in sorted(names)])
