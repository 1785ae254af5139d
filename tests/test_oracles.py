"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from signalloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(table, columns):
    plain = lambda x: None if x is None or x != x else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted([tuple(plain(r[c]) for c in columns) for r in table], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows([r.asDict() for r in got.collect()], columns) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
