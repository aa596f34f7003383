"""Registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from skeinery.plans import queries as core

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, clean.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, duck, name):
    got = core.QUERIES[name](spark, sf).toPandas()
    if name not in core.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(core.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
