import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from waymark.operators import agreement, models, vectors
from waymark.plans import jobs


def test_moments_with_tasks_that_have_no_rows(spark):
    """More tasks than rows, rows of weight 0 only in some, and no rows at all."""
    x = np.random.default_rng(5).normal(size=(3, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(3), "latent": x.tolist()}), "id long, latent array<double>").repartition(9, "id")
    assert 0 in df.rdd.glom().map(len).collect()
    n, s, c = vectors.moments(df, ["latent"])
    assert n == 3 and np.allclose(s, x.sum(axis=0)) and np.allclose(c, x.T @ x)
    found = vectors.moments_by(df.withColumns({"a": (F.col("id") == 1).cast("double"), "b": F.lit(0.0)}), ["latent"], ["a", "b"])
    assert found["a"][0] == 1 and np.allclose(found["a"][1], x[1]) and found["b"][0] == 0
    assert vectors.moments(df.limit(0), ["latent"])[0] == 0
    assert vectors.preprocess(df, "pca64").count() == 3


def test_drift_with_tasks_that_have_no_rows(spark):
    x = np.random.default_rng(6).normal(size=(12, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": range(12), "latent": x.tolist(), "state": x[:, :2].tolist(), "ref": [i % 2 == 0 for i in range(12)]}), "id long, latent array<double>, state array<double>, ref boolean")
    one, many = (agreement.drift_metrics(d, ["ref"], "ref").first() for d in (df.coalesce(1), df.repartitionByRange(40, "id")))
    assert one.n == many.n == 6 and abs(one.residual - many.residual) < 1e-9


def test_rule_drift_with_windows_cut_short(spark):
    """The last windows of a table may lack slots; they have nothing to predict."""
    x = np.random.default_rng(8).normal(size=(40, 2))
    rows = [(i, x[i : i + 3].tolist(), x[i : i + 3, :1].tolist()) for i in range(40)]
    cache = spark.createDataFrame(rows, "start long, emb array<array<double>>, act_emb array<array<double>>")
    masks = cache.select("start", F.lit(True).alias("ref"), (F.col("start") % 2 == 0).alias("a"))
    got = {r.split: r.n for r in jobs.run_rule_drift(cache, masks, ["a"], "ref").collect()}
    assert got == {"ref": 39, "a": 20} and models.training_rows(cache, 2).count() == 38
