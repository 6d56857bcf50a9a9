"""Every registered query against its SQL, on the same tables."""

import math

import duckdb
import pytest

from quarry import registry

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages")


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    own.sql("set timezone='UTC'")
    for t in TABLES:
        own.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return own


def plain(v):
    return float(f"{v:.10g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    out = registry.queries()[name](spark, SF)
    names = sorted(out.columns)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(n) for n in names]
    left = sorted(repr(tuple(plain(r[n]) for n in names)) for r in out.collect())
    right = sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
    assert left and left == right


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
