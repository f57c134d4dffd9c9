"""Every query of the library against its SQL twin in DuckDB, on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from kelpie.plans import registry

SF = Path("/root/testdata/sf0.001")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return str(int(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.10g}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, str(SF))
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
        return
    cols = sorted(got.columns)
    want = db.sql(sql)
    assert cols == sorted(want.columns)
    rows = sorted(tuple(cell(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    if SF.exists():
        assert e.entry(spark).count() > 0
