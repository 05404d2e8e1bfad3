"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from spanloom.plans import registries

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for r in registries() for n, q in r.queries.items()}
SQL = {n: q for r in registries() for n, q in r.sql.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(frame, columns):
    text = frame[columns].astype(object).where(frame[columns].notna(), None).map(lambda v: repr(round(v, 9)) if isinstance(v, float) else v).astype(str)
    return text.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got, columns).equals(plain(want, columns))


def test_others_run(spark):
    for name in sorted(QUERIES.keys() - SQL.keys()):
        assert QUERIES[name](spark, SF).count() >= 0
