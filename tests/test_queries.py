"""Every query of the engine against its SQL, on the smallest tables; the driver does the same on larger ones."""

import math
import os

import duckdb
import pytest

from pulsegrid.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(v):
    return repr(v) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    r = duck.sql(ORACLES[name])
    at = [r.columns.index(c) for c in sorted(df.columns)]
    assert len(r.columns) == len(at) and got == sorted(tuple(shown(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
