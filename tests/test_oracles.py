"""Every query with an oracle gives the oracle's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    yield connection
    connection.close()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return round(float(v), 4) + 0.0


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.collect()
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-4 * max(1, abs(u))) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
