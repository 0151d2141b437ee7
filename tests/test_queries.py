"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, df.columns) == rows(want.fetchall(), columns)
