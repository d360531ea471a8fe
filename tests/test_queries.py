"""Every query of the core against its SQL, at the smallest size."""

import os

import duckdb
import pytest

from tidemark.queries import corpus_core, running, streams

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = streams.QUERIES | running.QUERIES | corpus_core.QUERIES, streams.SQL | running.SQL | corpus_core.SQL
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    return f"{float(x):.6f}" if type(x).__name__ in ("float", "Decimal") else None if x is None else str(x)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=repr)
    if name not in SQL:
        assert got
        return
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in cursor.fetchall()], key=repr)
