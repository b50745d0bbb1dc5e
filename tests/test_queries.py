"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from modalflow import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "year"):
        return str(v)[:10]
    return float(v) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    res = db.execute(catalog.ORACLES[name])
    want = rows([c[0] for c in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in res.description)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_kernel_query_gives_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.limit(5).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
