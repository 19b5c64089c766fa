"""Every query with SQL gives the same rows as DuckDB; the others run and give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sparkeval import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or type(v).__name__ in ("NaTType", "NAType"):
        return "-"
    if type(v).__name__ in ("float", "float64", "float32", "Decimal"):
        return "-" if math.isnan(v) else f"{float(v):.6g}"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(name, spark, sf, duck):
    got = rows(catalog.queries()[name](spark, sf).toPandas())
    want = rows(duck.execute(catalog.oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
