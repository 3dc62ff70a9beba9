import duckdb
import pytest

from twinfold.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, FOLDER).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
