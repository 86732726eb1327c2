import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from waymark.operators import graph
from waymark.operators.neighbour_graph import descend


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, 12))
    x = centres[rng.integers(0, 25, n)] + 0.6 * rng.normal(size=(n, 12))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n) * 3 - 50, "latent": x.tolist()}), "id long, latent array<double>").cache()


def test_recall_and_work_at_two_sizes(spark):
    share = {}
    for n in (700, 3500):
        df = vectors(spark, n, n)
        found, compared = descend(df, 8, size=24)
        exact = {(r.id, r.nbr): r.sim for r in graph.knn(df, 8).collect()}
        got = found.collect()
        assert len(got) == 8 * n and len({(r.id, r.nbr) for r in got}) == len(got) and all(r.id != r.nbr for r in got)
        assert sum((r.id, r.nbr) in exact for r in got) >= 0.95 * len(exact)
        assert all(abs(exact[r.id, r.nbr] - r.sim) < 1e-9 for r in got if (r.id, r.nbr) in exact)
        share[n] = 2 * compared / n**2
    assert share[3500] < 0.35 and share[3500] < 0.4 * share[700]


def test_every_row_has_k_neighbours(spark):
    df = vectors(spark, 90, 1).unionByName(spark.range(1000, 1060).select("id", F.array(*[F.lit(1.0)] * 12).alias("latent")))  # sixty equal rows
    got = graph.knn_approx(df, 5).groupBy("id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert len(got) == 150 and all(r.n == r["last"] == 5 for r in got)
    few = vectors(spark, 4, 2)
    assert sorted((r.id, r.nbr) for r in graph.knn_approx(few, 10).collect()) == sorted((r.id, r.nbr) for r in graph.knn(few, 10).collect())
    assert graph.knn_approx(few.limit(0), 3).count() == 0


def test_exact_search_in_groups(spark, monkeypatch):
    """Any number of rows: many groups and blocks, equal rows (ties to the lower id), and fewer rows than k in a group."""
    monkeypatch.setattr(graph, "KNN_MOST", 100, raising=False)  # a limit that the search had
    monkeypatch.setattr(graph, "KNN_GROUP", 90, raising=False)
    monkeypatch.setattr(graph, "KNN_BLOCK", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 5))
    x[200:330] = x[7]
    ids = rng.permutation(5000)[:700] - 900
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "latent": x.tolist()}), "id long, latent array<double>")
    u = x[np.argsort(ids)] / np.linalg.norm(x[np.argsort(ids)], axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    s, ids = np.round(s, 12), np.sort(ids)
    for k in (3, 12):
        want = ids[np.argsort(-s, axis=1, kind="stable")[:, :k]]
        got = graph.knn(df, k).orderBy("id", "rank").toPandas()
        assert (got["nbr"].to_numpy().reshape(700, k) == want).all() and (got["rank"].to_numpy().reshape(700, k) == np.arange(1, k + 1)).all()
        assert np.allclose(got["sim"].to_numpy().reshape(700, k), -np.sort(-s, axis=1)[:, :k], atol=1e-11)
    assert graph.knn(df.limit(1), 3).count() == 0 and graph.knn(df.limit(0), 3).count() == 0 and graph.knn(df.limit(3), 5).count() == 6
