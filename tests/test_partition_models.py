import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import agreement, graph, models, partition, regions, risk, routing, vectors


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.25, (30, 2)) for c in ((-4, 0), (0, 4), (4, 0))])
    return spark.createDataFrame(pd.DataFrame({"id": range(90), "latent": x.tolist(), "grp": [i // 5 for i in range(90)]}), "id long, latent array<double>, grp long").cache()


def spectra(spark, gaps, step=0.001):
    rows = []
    for draw in range(3):
        for knn, e in zip((27, 30, 33), gaps, strict=True):
            rows += [(draw, knn, i, float(v)) for i, v in enumerate([0, 0.2, 1 - e, 1, *[1 + step * k for k in range(1, 11)]])]
    return spark.createDataFrame(rows, "draw int, knn int, idx int, eigenvalue double")


def test_gate_decisions(spark):
    assert graph.gate_decision(spectra(spark, (0.573, 0.574, 0.575))).first().choice == "spectral"
    unstable = graph.gate_decision(spectra(spark, (0.12, 0.17, 0.22))).first()
    assert unstable.choice == "global" and unstable.s < 0.5
    assert graph.gate_decision(spectra(spark, (0.03, 0.03, 0.03), 0.05)).first().reason == "residual_gap_not_above_background"


def test_spectrum_of_known_graphs(spark):
    n = 24
    ring = [(i, (i + d) % n, 1.0) for i in range(n) for d in (1, -1)]
    edges = spark.createDataFrame(ring, "i long, j long, w double")
    want = np.sort(1 - np.cos(2 * np.pi * np.arange(n) / n))[:6]
    assert np.allclose(graph.laplacian_spectrum(edges, 6), want, atol=1e-7)
    assert graph.components(edges.where("i < 12 AND j < 12 AND i <> 5 AND j <> 5")).select("c").distinct().count() == 2


def test_incomplete_spectra_are_refused(spark):
    whole = spectra(spark, (0.573, 0.574, 0.575))
    for part, said in (
        (whole.where("draw < 2"), "at least 3"),
        (whole.where("draw = 0 AND knn = 30"), "at least 3"),
        (whole.where("NOT (draw = 1 AND knn = 33)"), "draw 1 lacks"),
        (whole.where("knn <> 30"), "nominal"),
        (whole.where("idx < 5"), "14 eigenvalues"),
        (whole.where("NOT (draw = 2 AND knn = 27 AND idx = 13)"), "draw 2, 27 neighbours"),
        (whole.withColumn("eigenvalue", F.when(F.col("idx") == 4, float("nan")).otherwise(F.col("eigenvalue"))), "14 eigenvalues"),
        (whole.limit(0), "at least 3"),
    ):
        with pytest.raises(ValueError, match=said):
            graph.gate_decision(part)
    with pytest.raises(ValueError, match="announced"):
        graph.gate_decision(whole, draws=(0, 1, 7))
    with pytest.raises(ValueError, match="three draws"):
        graph.evaluate_gate(whole, seeds=(0,), knns=(10,))
    assert graph.gate_decision(whole).first().reason == "spectrally_nondegenerate"
    flat = graph.gate_decision(spectra(spark, (0.0, 0.0, 0.0))).first()
    assert (flat.reason, flat.s, flat.r) == ("candidate_gap_not_above_epsilon", None, None)


@pytest.mark.parametrize("whole_edges", [4_000_000, 500])
def test_many_spectra_in_one_run(spark, monkeypatch, whole_edges):
    """Graphs in tasks of their own, and the two larger ones spread over parts."""
    from waymark.operators import spectrum

    monkeypatch.setattr(spectrum, "WHOLE_EDGES", whole_edges)
    monkeypatch.setattr(spectrum, "PART_EDGES", 300)
    monkeypatch.setattr(spectrum, "DENSE", 1)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, n in enumerate((2, 9, 90, 150)):
        w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 8 / n), 1) + np.eye(n, k=1)
        w = w + w.T
        i, j = np.nonzero(w)
        rows += [(g, int(a) * 7 - 3, int(b) * 7 - 3, float(w[a, b])) for a, b in zip(i, j, strict=True)]
        d = w.sum(axis=1)
        want[g] = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    edges = spark.createDataFrame(rows, "g long, i long, j long, w double")
    vectors, values = spectrum.low_eigenpairs(edges, 5, tol=1e-6)
    values = {r["g"]: np.array(r["values"]) for r in values.collect()}
    got = vectors.toPandas()
    for g, (known, vecs) in want.items():
        assert np.allclose(values[g], known[::-1][:5], atol=1e-10)
        x = np.stack(got[got.g == g].sort_values("id")["x"].to_numpy())[:, : len(values[g])]
        assert np.allclose(x.T @ x, np.eye(x.shape[1]), atol=1e-8)
        for c in range(x.shape[1]):  # no near-equal values among these graphs
            assert abs(abs(x[:, c] @ vecs[:, ::-1][:, c]) - 1) < 1e-4
    with pytest.raises(Exception, match="residual"):
        spectrum.low_eigenpairs(edges, 5, tol=1e-9, most_products=3)
    assert spectrum.spectra(edges.limit(0), 5).count() == 0


def test_blobs_are_recovered(spark, blobs):
    part = partition.fit_spectral(blobs, 3, landmarks=90, neighbours=8, per_region=2)
    partition.validate_partition(part, 3)
    truth = blobs.select("id", F.floor(F.col("id") / 30).alias("label"))
    assert agreement.align(truth, part.labels.withColumnRenamed("region", "label"))[1] == 1.0
    assert part.prototypes.count() == 6
    again = partition.replay_artifact(blobs, part)
    assert again.exceptAll(part.labels).count() == 0


def test_router_forms_agree(spark, blobs):
    protos = spark.createDataFrame([(0, [1.0, 0.0], 5), (1, [1.0, 0.0], 6), (2, [-1.0, 0.1], 7)], "idx long, vec array<double>, owner long")
    a = routing.nearest_owner(blobs, protos, "latent").select("id", "region")
    b = routing.nearest_owner_sql(blobs, protos, "latent").select("id", "region")
    assert a.exceptAll(b).count() == 0 and {r.region for r in a.collect()} == {5, 7}  # the lower index wins the tie


def test_kmeans_and_global(spark, blobs):
    part = partition.fit_kmeans(blobs, 3, 1, restarts=2, niter=10)
    assert part.labels.select("region").distinct().count() == 3
    one = partition.fit_global(blobs)
    assert {r.region for r in one.labels.collect()} == {0}
    with pytest.raises(ValueError):
        partition.fit_partition(blobs, "other")


def test_knn_matches_brute_force(spark, blobs):
    got = {(r.id, r.rank): r.nbr for r in graph.knn(blobs, 3).collect()}
    x = np.array([r.latent for r in blobs.orderBy("id").collect()])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :3]
    assert all(got[i, k + 1] == top[i, k] for i in range(90) for k in range(3))


def test_linear_models_and_rollouts(spark):
    rng = np.random.default_rng(1)
    a = np.array([[0.9, 0.1], [-0.1, 0.8]])
    z = [rng.normal(size=2)]
    acts = rng.normal(size=(700, 1))
    for t in range(699):
        z.append(a @ z[-1] + 0.5 * acts[t, 0])
    rows = [(t, [z[t].tolist(), z[t + 1].tolist()], [acts[t].tolist(), acts[t + 1].tolist()]) for t in range(698)]
    cache = spark.createDataFrame(rows, "start long, emb array<array<double>>, act_emb array<array<double>>").cache()
    train = models.training_rows(cache)
    fitted = models.fit_models(train, None)
    m = models.load_models(fitted, 0, 1)
    assert models.predictor_loss(train, m[0]).first().loss < 1e-8
    inputs = models.rollout_inputs(cache, cache.select("start").limit(50), 4)
    loss = models.rollout_losses(inputs, m, [1, 4]).collect()
    assert len(loss) > 50 and max(r.terminal for r in loss) < 1e-6
    one = models.one_step_losses(train, m).join(inputs.select("start"), "start")
    h1 = models.rollout_losses(inputs, m, [1])
    assert one.join(h1, "start").where("abs(loss - terminal) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        models.fit_regional(train.limit(10), train.select(F.col("start").alias("id"), F.lit(0).alias("region")), 1)
    with pytest.raises(ValueError):
        models.load_models(fitted, 0, 2)


def test_risk_fixture(spark):
    r = spark.createDataFrame([(0, 0.25, 1.0, 0.5, 2.0, 2.0), (1, 0.75, 2.0, 1.0, 3.0, 3.0)], "region long, region_weight double, global_mse double, correct_mse double, wrong_mean_mse double, wrong_best_mse double")
    row = risk.weighted_summary(r).first()
    assert (row.global_mse, row.correct_mse) == (1.75, 0.875)
    with pytest.raises(ValueError):
        risk.expert_losses(r, 1)
    b = spark.createDataFrame([(0, 1.0, 0.5), (1, 2.0, 1.5), (2, 3.0, 2.5)], "i long, global_mse double, correct_mse double")
    assert risk.paired_bootstrap(b, 50, 1).collect() == risk.paired_bootstrap(b.repartition(3), 50, 1).collect()


def test_vectors(spark, blobs):
    q, residual = vectors.procrustes(blobs.withColumn("t", F.array(F.get("latent", F.lit(1)), F.get("latent", F.lit(0)))), "latent", "t")
    assert np.allclose(np.abs(q), [[0, 1], [1, 0]], atol=1e-9) and abs(residual) < 1e-9
    assert set(vectors.VARIANTS) >= {"raw", "pca64"}
    for name in ("raw", "centre", "zscore"):
        z = vectors.preprocess(blobs, name).select("z").first().z
        assert abs(np.linalg.norm(z) - 1) < 1e-9


def test_regions(spark):
    rows = spark.createDataFrame([(106.9, 50.0), (107.0, 50.0), (117.0, 50.0), (117.1, 100.0), (float("nan"), 1.0)], "x double, y double")
    assert [r.k for r in rows.select(regions.rooms3(F.col("x")).alias("k")).collect()] == [0, 1, 1, 2, None]
    assert [r.k for r in rows.select(regions.priority5(F.col("x"), F.col("y")).alias("k")).collect()] == ["left_room", "doorway", "doorway", "common", None]


def test_moments_of_several_weights_in_one_pass(spark):
    from waymark.operators.vectors import moments, moments_by

    x = np.random.default_rng(3).normal(size=(60, 4))
    w = np.arange(60) % 3 == 0
    rows = [(r.tolist(), float(a), float(not a), 0.0) for r, a in zip(x, w, strict=True)]
    df = spark.createDataFrame(rows, "x array<double>, a double, b double, none double").repartition(3)
    got = moments_by(df, ["x"], ["a", "b", "none"])
    for name, keep in (("a", w), ("b", ~w)):
        n, s, c = got[name]
        assert n == keep.sum()
        np.testing.assert_allclose(s, x[keep].sum(axis=0))
        np.testing.assert_allclose(c, x[keep].T @ x[keep])
    assert got["none"][0] == 0
    np.testing.assert_allclose(moments(df, ["x"])[2], x.T @ x)


def test_spectral_labels_find_two_cliques(spark):
    from waymark.operators.graph import spectral_labels

    pairs = [(i + o, j + o, 1.0) for o in (0, 10) for i in range(6) for j in range(6) if i != j] + [(0, 10, 0.05), (10, 0, 0.05)]
    got = {r["id"]: r["region"] for r in spectral_labels(spark.createDataFrame(pairs, "i long, j long, w double"), 2).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]


def test_best_assignment_is_the_best_of_all():
    import itertools

    from waymark.operators.agreement import best_assignment

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 6):
        for _ in range(30):
            gain = rng.integers(0, 6, (n, n)).astype(float)
            want = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            got = best_assignment(gain)
            assert sorted(got) == list(range(n)) and sum(gain[i, j] for i, j in enumerate(got)) == want


def test_kmeans_runs_share_passes_and_agree(spark):
    from waymark.operators import partition

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((-4, 0), (0, 4), (4, 0))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, z array<double>")
    many = partition.spherical_kmeans_runs(z, 3, [5, 6, 7], 6, rel_tol=1e-6)
    for seed, (centres, told) in zip((5, 6, 7), many, strict=True):
        one, alone = partition.spherical_kmeans(z, 3, 6, seed, rel_tol=1e-6)
        assert np.allclose(one, centres) and np.allclose(alone, told)
        best = (x @ centres.T).max(axis=1).mean()
        assert best >= told[-1] - 1e-9


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(250, 16)), rng.normal(size=(8, 16)).repeat(20, axis=0) + 0.1 * rng.normal(size=(160, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, latent array<double>")
    want = {(r.id, r.nbr) for r in graph.knn(df, 10).collect()}
    got = {(r.id, r.nbr) for r in graph.knn_approx(df, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    narrow = graph.knn_approx(df, 10, size=10).collect()  # lists no longer than what is asked for
    assert len(narrow) == 10 * len(x) and {r["rank"] for r in narrow} == set(range(1, 11))
