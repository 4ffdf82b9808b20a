import duckdb
import pytest

from shaleview import catalog


def normal(rows):
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x if isinstance(x, (int, type(None))) else str(x) for x in r) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    import os

    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    d = catalog.QUERIES[name](spark, sf)
    columns = sorted(d.columns)
    r = duck.sql(catalog.SQL[name])
    assert sorted(r.columns) == columns
    assert normal(tuple(x) for x in d.select(*[f"`{c}`" for c in columns]).collect()) == normal(r.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
