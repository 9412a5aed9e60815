"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from specgrid import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def close(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-5) or math.isnan(x) and math.isnan(y)))


def key(row):
    """Exact values first; numbers, rounded, only tell rows apart that agree in those."""
    exact = tuple("" if x is None else str(x) for x in row if not isinstance(x, float))
    return exact, tuple(x if isinstance(x, float) and not math.isnan(x) else -math.inf for x in row if x is None or isinstance(x, float))


def same(rows, want):
    """Whether the rows pair up: each with the first left of those that agree in what is exact and are close in the numbers."""
    left = {}
    for row in want:
        left.setdefault(tuple(None if isinstance(x, float) else x for x in row), []).append(row)
    for row in rows:
        near = left.get(tuple(None if isinstance(x, float) else x for x in row), [])
        at = next((i for i, other in enumerate(near) if all(map(close, row, other))), None)
        if at is None:
            return row, near[:1]
        near.pop(at)
    return None


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = sorted(map(tuple, df.collect()), key=key)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=key)
    assert len(rows) == len(want)
    off = None if all(all(map(close, a, b)) for a, b in zip(rows, want, strict=True)) else same(rows, want)
    assert off is None, off
