"""Every registered query of the library that has SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from waymark.plans import queries as _queries  # noqa: F401
from waymark.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    f = lambda x: "null" if x is None else ("nan" if math.isnan(x) else f"{x + 0.0:.9g}") if isinstance(x, float) else str(x)
    return sorted(cols), sorted(tuple(f(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert got == norm(cur.fetchall(), cols)


def test_stream_equals_batch(spark):
    if os.path.isdir(DATA):
        assert QUERIES["v8_stream_histogram"](spark, DATA).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
