from pathlib import Path

import pytest

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMOKE).exists(), reason="no test data")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "topic", "z"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", ["p2_found", "p4_found", "raw_filter", "monthly_returns", "validity_join", "bigrams"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SMOKE).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got = entry.queries()[name](spark, SMOKE)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    a, b = got.select(key).toPandas().astype(str), want.df()[key].astype(str)
    assert sorted(map(tuple, a.values)) == sorted(map(tuple, b.values))
