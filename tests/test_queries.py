"""Every registered query of the quote engine against its SQL: numbers with a fraction nearly, everything else exactly."""

import math
import os

import duckdb
import pytest

from quotelark import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con


def plain(value):
    """Text, and the number where it is one with a fraction: ids, counts and times have none."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "", None
    return (f"{value + 0.0:.5f}", value) if isinstance(value, float) else (str(value), None)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda row: [t for t, _ in row])


def same(p, q):
    return p[0] == q[0] or None not in (p[1], q[1]) and abs(p[1] - q[1]) <= 2e-5 * max(1.0, abs(p[1]))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))][:3] == []


def test_whole_numbers_are_compared_exactly():
    assert not same(plain(1_700_000_000_180), plain(1_700_000_000_179)) and same(plain(0.25), plain(0.250001)) and not same(plain("a"), plain(None))
