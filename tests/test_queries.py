"""Every query runs on the smallest tables, and those with a DuckDB twin give its rows."""

import math
import os

import duckdb
import pytest

from wayfind import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.5f}"
    return None if v is None else str(v)


def rows(found):
    return sorted([tuple(map(cell, r)) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    if sql := catalog.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(want.columns) == columns
        numbers = {c: k for k, c in enumerate(want.columns)}
        want = rows([tuple(float(r[numbers[c]]) if type(r[numbers[c]]).__name__ == "Decimal" else r[numbers[c]] for c in columns) for r in want.fetchall()])
        assert got == want
