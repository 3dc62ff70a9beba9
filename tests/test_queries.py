import duckdb
import pytest

from twinfold.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "events", "lineitem"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(round(v[k], 6)) if isinstance(v[k], float) else str(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
