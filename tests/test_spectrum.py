import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import graph, spectrum


@pytest.fixture
def spread(monkeypatch):
    monkeypatch.setattr(spectrum, "WHOLE_EDGES", 50)
    monkeypatch.setattr(spectrum, "PART_EDGES", 200)
    monkeypatch.setattr(spectrum, "JOB_BYTES", 1, raising=False)


def rings(spark, sizes):
    """Rings with chords, without an edge between them."""
    at, rows = 0, []
    for n in sizes:
        rows += [(at + a, at + (a + s) % n, 1.0 + a % 3 + (a + s) % n % 3) for a in range(n) for s in (1, 2, 5, n - 1, n - 2, n - 5)]
        at += n
    return spark.createDataFrame(rows, "i long, j long, w double").withColumn("g", F.lit(4).cast("long"))


def test_shuffle_files_go_with_their_job(spark, spread):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    edges = rings(spark, [300]).cache()
    edges.count()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key)
    vectors, values = spectrum.low_eigenpairs(edges, 3)
    assert files() - before < 60  # each product of the dozens had a shuffle of some twenty files
    assert spark.conf.get(key) == was
    w = np.zeros((300, 300))
    for r in edges.collect():
        w[r.i, r.j] = r.w
    d = w.sum(axis=1)
    assert np.allclose(values.first()["values"], np.linalg.eigvalsh(w / np.sqrt(np.outer(d, d)))[::-1][:3], atol=1e-8)
    assert vectors.count() == 300


def test_vectors_of_components_are_known(spark, spread, monkeypatch):
    def never(*_):
        raise AssertionError("no product is needed")

    monkeypatch.setattr(spectrum, "_product", never)
    edges = rings(spark, [40, 60, 90])
    d = {r.i: r.d for r in edges.groupBy("i").agg(F.sum("w").alias("d")).collect()}
    for count in (2, 3):
        vectors, values = spectrum.low_eigenpairs(edges, count)
        x = np.array([r.x for r in vectors.orderBy("id").collect()])
        assert values.first()["values"] == [1.0] * count and np.allclose(x.T @ x, np.eye(count))
        a = np.zeros((190, 190))
        for r in edges.collect():
            a[r.i, r.j] = r.w / np.sqrt(d[r.i] * d[r.j])
        assert np.allclose(a @ x, x)
    found = {(r.id < 40, r.id < 100, r.region) for r in graph.spectral_labels(edges, 3).collect()}
    assert len(found) == 3 and len({f[2] for f in found}) == 3
