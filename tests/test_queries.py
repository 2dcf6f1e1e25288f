"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from lodestone import catalog_queries, surface_queries

QUERIES = catalog_queries.QUERIES | surface_queries.QUERIES
ORACLES = catalog_queries.ORACLES | surface_queries.ORACLES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(ORACLES[name])
    expected = table([d[0] for d in found.description], found.fetchall())
    assert table(df.columns, df.collect()) == expected


def test_queries_without_sql_run(spark, small):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
