"""Every query with SQL against DuckDB over the smallest tables; the entry point."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from prosemill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, list):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted([plain(x) for x in r] for r in df.select(*[f"`{c}`" for c in names]).collect())
    assert got == sorted([plain(x) for x in r] for r in want.fetchall())


def test_entry_points():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(registry.QUERIES) <= set(q) and set(s) <= set(q)
