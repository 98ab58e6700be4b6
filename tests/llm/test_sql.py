"""The registered queries: those with SQL against DuckDB, all of them for shape."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("op")]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF)
    rows = got.collect()
    if name not in ("op7_decontamination", "op10_paragraph_dedup", "op13_source_divergence"):  # these return what they found
        table = "pages" if name.startswith("op5_") else "documents"
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
        relation = con.sql(sql)
        names = relation.columns
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(str, (tuple(r[n] for n in names) for r in rows))) == sorted(map(str, relation.fetchall()))


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()
