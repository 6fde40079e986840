"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

DATA = os.environ.get("STRATALINE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert df.columns
        return
    cur = sql.execute(oracle)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in got) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns
