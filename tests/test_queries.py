"""Each query beside its SQL, the same rows."""

from __future__ import annotations

import duckdb
import pytest

from barograph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def plain(x):
    if isinstance(x, float):
        return f"{x:.5f}" if x == x else None
    return str(x).replace(" 00:00:00", "") if x is not None else None


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    key = lambda r: tuple(x or "" for x in r)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=key)
    assert sorted(df.columns) == sorted(cols) and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_of_the_rest(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
