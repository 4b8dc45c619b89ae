"""Every query with SQL against DuckDB on the small tables; the others must run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from lamina.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
        return str(x)

    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert canonical(df.columns, rows) == canonical(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
