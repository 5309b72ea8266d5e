"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from strandlake import registry
from strandlake.sources.derived import TABLES

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert len(rows) > 0
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = [tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == sorted(theirs, key=repr)
