import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import pivot_search as module
from waymark.llm.pivot_search import exact_top_k
from waymark.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, cid string, v string, id string"


def brute(rows, modulus, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % modulus == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda x: np.array(x + [0] * (12 - len(x)), dtype="<i8").tobytes())
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def vectors(rng, n, dim=12, groups=8):
    centres = rng.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_op12_clusters_norms_and_ties(spark, monkeypatch):
    monkeypatch.setattr(module, "ANNULUS_ROWS", 7)
    monkeypatch.setattr(module, "BUCKET_LEAST", 20)
    rng = np.random.default_rng(1)
    rows = vectors(rng, 400)
    rows += [(1000 + i, [0.5] * 12) for i in range(90)]  # a hot vector
    rows += [(2000 + i, rng.integers(-1, 2, 12).astype(float).tolist()) for i in range(200)]  # equal scores
    rows += [(3000, [0.0] * 12), (3010, [1e4] * 12), (3020, [0.25] * 5), (3030, []), (3040, None), (3050, [None] * 12), (3060, [math.nan] * 12), (3070, [math.inf] + [0.0] * 11)]
    rows += [(40, [2.0] * 12), (40, [1.0] * 12), (41, [2.0] * 12), (41, [2.0] * 12), (None, [1.0] * 12)]
    got = exact_top_k(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_op12_bounds_leave_out_buckets(spark, monkeypatch):
    monkeypatch.setattr(module, "ANNULUS_ROWS", 16)
    monkeypatch.setattr(module, "BUCKET_LEAST", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8)) * 3
    rows = [(i, (centres[i % 30] + 0.02 * rng.normal(size=8)).tolist()) for i in range(3000)]
    scanned = []
    whole = module._scores
    monkeypatch.setattr(module, "_scores", lambda q, x, wide: scanned.append(len(q) * len(x)) or whole(q, x, wide))
    points = np.floor(256 * np.array([v for _, v in rows]))
    p = module.Pivots(points, int((points**2).sum(axis=1).max()), 1)
    away = p.of_vectors(points)
    own = away.argmin(axis=1)
    cut = [r for k in range(len(p.at)) for r in [np.flatnonzero(own == k)] if len(r)]
    cut = [r[np.argsort(away[r, k])] for r in cut for k in [own[r[0]]]]
    made = [{"pivot": int(own[r[0]]), "lo": away[r, own[r[0]]].min(), "hi": away[r, own[r[0]]].max(), "n": len(r), "ids": r.astype(np.int64).tobytes() * 2, "vecs": points[r].astype("<i2").tobytes()} for r in cut]
    module._Bucket(made, "<i2").search(p, points[:60], np.full(60, -np.inf), 6, False)
    assert sum(scanned) < 0.6 * 60 * 3000
    assert sorted(map(tuple, exact_top_k(table(spark, rows), F.col("vec_id") % 50 == 0).collect())) == brute(rows, 50)


def test_op12_few_rows_and_wide_scores(spark):
    assert exact_top_k(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert exact_top_k(table(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    few = [(0, [1.0, -2.0]), (1, [0.5, 0.1]), (50, [-1.0, 0.0])]
    assert sorted(map(tuple, exact_top_k(table(spark, few), F.col("vec_id") % 50 == 0).collect())) == brute(few, 50)
    rng = np.random.default_rng(3)
    wide = [(i, (rng.normal(size=4) * 1e6).tolist()) for i in range(200)]
    assert sorted(map(tuple, exact_top_k(table(spark, wide), F.col("vec_id") % 50 == 0).collect())) == brute(wide, 50)
    with pytest.raises(ValueError, match="64 bits"):
        exact_top_k(table(spark, [(0, [1e300]), (1, [1.0])]), F.col("vec_id") % 50 == 0)


def test_op12_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = QUERIES["op12_pivot_top_k"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(SQL["op12_pivot_top_k"]).fetchall())
