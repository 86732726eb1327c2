"""Partition fitting (C1-C19).  A partition is labels (id, region), prototypes (idx, vec, owner) and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.common import checked, discard, dot, materialize, seeded, uniform
from waymark.operators.agreement import classification_metrics
from waymark.operators.graph import affinity_graph, components, evaluate_gate, knn, spectral_labels
from waymark.operators.routing import nearest_owner, route
from waymark.operators.sampling import group_holdout, landmark_sample, sample_n
from waymark.operators.vectors import l2_normalize, zscore_l2, zscore_l2_fit


@dataclass
class Partition:
    labels: DataFrame
    prototypes: DataFrame
    stats: DataFrame
    meta: dict = field(default_factory=dict)


def fit_global(df: DataFrame, col: str = "latent") -> Partition:
    """One region; its prototype is zeros."""
    stats = zscore_l2_fit(df, col)
    protos = stats.select(F.lit(0).cast("long").alias("idx"), F.transform("mean", lambda _: F.lit(0.0)).alias("vec"), F.lit(0).cast("long").alias("owner"))
    return Partition(df.select("id", F.lit(0).cast("long").alias("region")), protos, stats, {"method": "global", "k": 1})


def pick_prototypes(z: DataFrame, k: int, seed: int, col: str = "z") -> DataFrame:
    """(idx, vec, owner): the first k rows in md5 order."""
    rows = z.select("id", F.col(col).alias("vec"), seeded(seed, "id").alias("_k")).orderBy("_k", "id").limit(k).collect()  # k rows
    return z.sparkSession.createDataFrame([(i, [float(x) for x in r["vec"]], i) for i, r in enumerate(rows)], "idx long, vec array<double>, owner long")


def fit_random_voronoi(df: DataFrame, k: int, seed: int, col: str = "latent") -> Partition:
    """K random rows are the prototypes; an empty region is an error."""
    stats = zscore_l2_fit(df, col)
    z = zscore_l2(df.select("id", col), stats, col)
    protos = pick_prototypes(z, k, seed)
    labels = nearest_owner(z, protos).select("id", "region")
    if labels.select("region").distinct().count() != k:
        raise ValueError("a region is empty")
    return Partition(labels, protos, stats, {"method": "random_voronoi", "k": k, "seed": seed})


def init_random(z: DataFrame, k: int, seed: int, col: str = "z") -> np.ndarray:
    """K rows in md5 order."""
    return np.array([r["vec"] for r in pick_prototypes(z, k, seed, col).orderBy("idx").collect()])


def init_kmeanspp(z: DataFrame, k: int, seed: int, col: str = "z") -> np.ndarray:
    """Rows by probability max(0, 1 - best cosine), as the least exponential key -ln(u) / weight; one pass a centre."""
    return _plusplus(z, k, [seed], col)[0]


def _plusplus(z: DataFrame, k: int, seeds: list[int], col: str) -> np.ndarray:
    """k-means++ centres [seed, centre, dim]; a pass serves all seeds, and only each task's least keys leave it."""
    centres = np.stack([init_random(z, 1, s, col) for s in seeds])
    for i in range(1, k):

        def least(batches: Iterator[pd.DataFrame], sets: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack([np.asarray(a, dtype=np.float64) for a in pdf[col]])
                best = (x @ sets.reshape(-1, x.shape[1]).T).reshape(len(x), len(sets), -1).max(axis=2)
                key = -np.log1p(-np.stack(pdf["u"].to_numpy())) / np.maximum(np.maximum(0.0, 1 - best), 1e-300)
                at = [np.lexsort((pdf["id"], key[:, s]))[0] for s in range(len(sets))]
                yield pd.DataFrame({"s": range(len(sets)), "key": key[at, range(len(sets))], "id": pdf["id"].to_numpy()[at], "vec": list(x[at])})

        rows = z.select(col, "id", F.array(*[uniform(s * 1000 + i, "id") for s in seeds]).alias("u"))
        found = rows.mapInPandas(least, "s int, key double, id long, vec array<double>").groupBy("s").agg(F.min(F.struct("key", "id", "vec")).alias("x")).collect()  # a row per seed
        more = np.stack([r["x"]["vec"] for r in sorted(found, key=lambda r: r["s"])])
        centres = np.concatenate((centres, more[:, None, :]), axis=1)
    return centres


def _assign_sums(z: DataFrame, centres: np.ndarray, col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, objectives) of one assignment to each set of centres [set, centre, dim]; a partial row per task and centre."""
    sets, k, dim = centres.shape

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n, best = np.zeros_like(centres), np.zeros((sets, k)), np.zeros(sets)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(a, dtype=np.float64) for a in pdf[col]])
            d = (x @ centres.reshape(-1, dim).T).reshape(len(x), sets, k)
            at = np.round(d, 12).argmax(axis=2)
            for r in range(sets):
                np.add.at(s[r], at[:, r], x)
                n[r] += np.bincount(at[:, r], minlength=k)
                best[r] += d[np.arange(len(x)), r, at[:, r]].sum()
        yield pd.DataFrame({"c": range(sets * k), "s": list(s.reshape(-1, dim)), "n": n.ravel(), "o": np.repeat(best, k)})

    parts = z.select(col).mapInPandas(part, "c int, s array<double>, n double, o double")
    flat = parts.select("c", "n", "o", F.posexplode("s").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("o").alias("o")).toArrow()  # sets * K * D rows
    s, n, o = np.zeros((sets * k, dim)), np.zeros(sets * k), np.zeros(sets * k)
    c = flat.column("c").to_numpy()
    s[c, flat.column("d").to_numpy()], n[c], o[c] = flat.column("x").to_numpy(), flat.column("n").to_numpy(), flat.column("o").to_numpy()
    n = n.reshape(sets, k)
    return s.reshape(sets, k, dim), n, o.reshape(sets, k)[:, 0] / np.maximum(n.sum(axis=1), 1)


def spherical_kmeans_runs(z: DataFrame, k: int, seeds: list[int], niter: int = 25, init: str = "kmeanspp", col: str = "z", rel_tol: float | None = None, patience: int = 2) -> list[tuple[np.ndarray, list[float]]]:
    """A fit for each seed, all in the same passes: assign by largest dot, centroid = normalised mean, empty ones reseeded.

    With ``rel_tol`` a fit stops when its objective's relative change stays below it for ``patience`` rounds.
    """
    centres = _plusplus(z, k, seeds, col) if init == "kmeanspp" else np.stack([init_random(z, k, s, col) for s in seeds])
    told: list[list[float]] = [[] for _ in seeds]
    calm, open_ = [0] * len(seeds), list(range(len(seeds)))
    for i in range(niter):
        sums, counts, objectives = _assign_sums(z, centres[open_], col)
        going = []
        for r, s, n, objective in zip(open_, sums, counts, objectives, strict=True):
            told[r].append(float(objective))
            empty = np.flatnonzero(n == 0)
            if len(empty):
                s[empty] = init_random(z, len(empty), seeds[r] + 7919 * (i + 1), col)
            centres[r] = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
            if rel_tol is not None and len(told[r]) > 1:
                last, now = told[r][-2:]
                calm[r] = calm[r] + 1 if abs(now - last) <= rel_tol * max(abs(last), 1e-12) else 0
            if rel_tol is None or calm[r] < patience:
                going.append(r)
        open_ = going
        if not open_:
            break
    return list(zip(centres, told, strict=True))


def spherical_kmeans(z: DataFrame, k: int, niter: int = 25, seed: int = 0, init: str = "kmeanspp", col: str = "z", rel_tol: float | None = None, patience: int = 2) -> tuple[np.ndarray, list[float]]:
    """(centroids, objectives) of one seed."""
    return spherical_kmeans_runs(z, k, [seed], niter, init, col, rel_tol, patience)[0]


def centroid_table(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c], i) for i, c in enumerate(centres)], "idx long, vec array<double>, owner long")


def objective(z: DataFrame, centroids: DataFrame, col: str = "z") -> DataFrame:
    """The mean of the best cosine; centroids are one row of a broadcast, not of the plan."""
    protos = centroids.agg(F.collect_list("vec").alias("_protos"))  # K rows
    return z.select(col).crossJoin(F.broadcast(protos)).agg(F.avg(F.array_max(F.transform("_protos", lambda p: dot(F.col(col), p)))).alias("objective"))


def fit_kmeans(df: DataFrame, k: int, seed: int = 0, restarts: int = 1, cap: int | None = None, col: str = "latent", niter: int = 25) -> Partition:
    """Fit on at most k * cap rows (all without a cap), the best of the restarts, assign all."""
    stats = materialize(zscore_l2_fit(df, col))
    z = materialize(zscore_l2(df.select("id", col), stats, col).drop(col))
    fit_on = z if cap is None else materialize(sample_n(z, k * cap, seed))
    runs = spherical_kmeans_runs(fit_on, k, [seed * 100_000 + i for i in range(restarts)], niter)
    best = max(range(restarts), key=lambda i: (runs[i][1][-1], -i))
    centres, told = runs[best]
    protos = centroid_table(df.sparkSession, centres)
    return Partition(nearest_owner(z, protos).select("id", "region"), protos, stats, {"method": "kmeans", "k": k, "seed": seed, "restart": best, "objective": told[-1]})


def best_restart(runs: DataFrame, budget: int) -> DataFrame:
    """Per outer seed the best of its first ``budget`` restarts; ties to the earliest."""
    return runs.where(F.col("restart") < budget).groupBy("outer_seed").agg(F.max_by("restart", F.struct("objective", -F.col("restart"))).alias("restart"), F.max("objective").alias("objective"))


def _region_sums(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Region -> [start, prototype, dim + 2]: sums of the rows nearest to each prototype of their region, their number and cosines.

    A partial row per task, region, start, prototype and dimension that has one; tasks don't know of regions.
    """
    starts, k, dim = next(iter(centres.values())).shape

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            region = pdf["region"].to_numpy()
            for g in np.unique(region).tolist():
                x = np.stack(pdf["x"][region == g].to_numpy())
                s = np.round(np.einsum("nd,rkd->nrk", x, centres[g]), 12)
                at = s.argmax(axis=2)
                one = total.setdefault(g, np.zeros((starts, k, dim + 2)))
                for r in range(starts):
                    np.add.at(one[r], at[:, r], np.concatenate((x, np.ones((len(x), 1)), s[np.arange(len(x)), r, at[:, r]][:, None]), axis=1))
        for g, one in total.items():
            c = np.flatnonzero(one.any(axis=2).ravel())
            yield pd.DataFrame({"region": g, "c": np.repeat(c, dim + 2), "d": np.tile(np.arange(dim + 2), len(c)), "x": one.reshape(-1, dim + 2)[c].ravel()})

    got = rows.mapInPandas(part, "region long, c int, d int, x double").groupBy("region", "c", "d").agg(F.sum("x").alias("x")).toPandas()  # regions * starts * prototypes * dim rows
    out = {g: np.zeros((starts * k, dim + 2)) for g in centres}
    for g, one in got.groupby("region"):
        out[int(g)][one["c"].to_numpy(), one["d"].to_numpy()] = one["x"].to_numpy()
    return {g: x.reshape(starts, k, dim + 2) for g, x in out.items()}


def fit_prototypes(z: DataFrame, labels: DataFrame, per_region: int, seed: int = 0, n_init: int = 4, col: str = "z", rounds: int = 20) -> DataFrame:
    """(idx, vec, owner): centroids inside each region, by spherical k-means of all regions and starts in the same passes.

    A start's first centroids are the rows of a region that come first by md5;
    a region keeps its start with the largest mean cosine.  Passes end early
    when no centroid moves.  A region of fewer rows than ``per_region`` is an error.
    """
    rows = materialize(z.join(labels, "id").select("id", F.col(col).cast("array<double>").alias("x"), F.col("region").cast("long").alias("region")))
    if rows.groupBy("region").count().where(F.col("count") < per_region).limit(1).count():
        raise ValueError("a region has fewer rows than prototypes")
    first = None
    for r in range(n_init):
        nth = F.row_number().over(Window.partitionBy("region").orderBy(seeded(seed * 100 + r, "id"), "id"))
        own = rows.withColumn("nth", nth).where(F.col("nth") <= per_region).select("region", F.lit(r).alias("r"), "nth", "x")
        first = own if first is None else first.unionByName(own)
    got = first.orderBy("region", "r", "nth").toPandas()  # regions * starts * prototypes
    centres = {int(g): np.stack(one["x"].to_numpy()).reshape(n_init, per_region, -1) for g, one in got.groupby("region")}
    if not centres:
        return z.sparkSession.createDataFrame([], "idx long, vec array<double>, owner long")
    for _ in range(rounds):
        sums, moved = _region_sums(rows, centres), 0.0
        for g, one in sums.items():
            new = np.where(one[:, :, -2:-1] > 0, one[:, :, :-2], centres[g])
            new = new / np.maximum(np.linalg.norm(new, axis=2, keepdims=True), 1e-12)
            moved, centres[g] = max(moved, float(np.abs(new - centres[g]).max())), new
        if moved < 1e-12:
            break
    told = {g: one[:, :, -1].sum(axis=1) for g, one in _region_sums(rows, centres).items()}
    discard(rows)
    out = [(g * per_region + i, [float(v) for v in c], g) for g in sorted(centres) for i, c in enumerate(centres[g][int(np.argmax(np.round(told[g], 9)))])]
    return z.sparkSession.createDataFrame(out, "idx long, vec array<double>, owner long")


def graph_with_fallback(near: DataFrame, k: int, k2: int, regions: int) -> DataFrame:
    """The graph of k neighbours, or of k2 if it falls into more components than regions; an error if that does too."""
    for n in (k, k2):
        edges = materialize(affinity_graph(near, n))
        if components(edges).select("c").distinct().count() <= regions:
            return edges
    raise ValueError("the graph has more components than regions")


def fit_spectral(df: DataFrame, k: int, seed: int = 0, landmarks: int = 20_000, neighbours: int = 30, per_region: int = 16, group: str = "grp", col: str = "latent", fallback: int = 50) -> Partition:
    """Labels of all rows by prototypes of the spectral regions of a landmark sample."""
    stats = materialize(zscore_l2_fit(df, col))
    z = materialize(zscore_l2(df, stats, col))
    sample = materialize(landmark_sample(z, landmarks, seed, group).drop("turn"))
    edges = graph_with_fallback(materialize(knn(sample, max(neighbours, fallback), "z")), neighbours, fallback, k)
    labels = materialize(spectral_labels(edges, k, seed))
    protos = materialize(fit_prototypes(sample, labels, per_region, seed))
    return Partition(nearest_owner(z, protos).select("id", "region"), protos, stats, {"method": "spectral", "k": k, "seed": seed, "landmarks": landmarks})


def select_prototypes(z: DataFrame, labels: DataFrame, group: str, candidates: tuple = (16, 32), seed: int = 0, min_f1: float = 0.97, min_recall: float = 0.95) -> tuple[int, DataFrame]:
    """C11: the first number of prototypes whose router is true to held-out labels; an error if none is."""
    from waymark.operators.agreement import per_class

    rows = z.join(labels, "id")
    held = group_holdout(rows, group, "region", 0.2, seed)
    rows = materialize(rows.join(held, group))
    for p in candidates:
        protos = fit_prototypes(rows.where(~F.col("holdout")).drop("region"), rows.where(~F.col("holdout")).select("id", "region"), p, seed)
        told = nearest_owner(rows.where("holdout").withColumnRenamed("region", "y"), protos, "z", "p")
        if classification_metrics(told).first()["macro_f1"] >= min_f1 and per_class(told).where("support > 0").agg(F.min("recall")).first()[0] >= min_recall:
            return p, protos
    raise ValueError("no number of prototypes is true enough to the labels")


def fit_auto(df: DataFrame, k: int = 3, **settings) -> Partition:
    """Spectral if the gate finds a real gap, else one region; the gate's settings are the fit's."""
    spectra, decision = evaluate_gate(zscore_l2(df, zscore_l2_fit(df)).withColumn("latent", F.col("z")).drop("z"), k, **settings)
    told = decision.first().asDict()
    part = fit_spectral(df, k, landmarks=settings.get("landmarks", 20_000), group=settings.get("group", "grp")) if told["choice"] == "spectral" else fit_global(df)
    part.meta["gate"] = told
    return part


def replay_artifact(df: DataFrame, part: Partition, col: str = "latent") -> DataFrame:
    """C14: labels anew from the artifact."""
    return route(df, part.prototypes, part.stats, col).select("id", "region")


def replay_assignments(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their recorded labels; repeated or missing ids are errors."""
    checked(labels, labels.groupBy("id").count().where("count > 1"), "an id is labelled twice")
    return checked(df, df.join(labels, "id", "left_anti"), "an id has no label").join(labels, "id")


def remap_ids(labels: DataFrame, ids: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Labels by dense index to labels by global id; ids outside 0..n-1 are taken as global already."""
    from waymark.functions.common import global_rank

    n = ids.count()
    low, high = labels.agg(F.min("id"), F.max("id")).first()
    if low is not None and low >= 0 and high < n:
        dense = global_rank(ids.select(F.col("id").alias("gid")), ["gid"], "_r")
        out = labels.join(dense.select((F.col("_r") - 1).alias("id"), "gid"), "id").select(F.col("gid").alias("id"), "region")
    else:
        out = labels.join(ids, "id", "left_semi")
    return out if training is None else checked(out, training.join(out, "id", "left_anti"), "a training start has no label")


def centroids(z: DataFrame, labels: DataFrame, col: str = "z") -> DataFrame:
    """C17: (region, vec): the L2-normalised mean of each region."""
    per = z.join(labels, "id").select("region", F.posexplode(col).alias("d", "x")).groupBy("region", "d").agg(F.avg("x").alias("x"))
    vec = per.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("vec"))
    return vec.withColumn("vec", l2_normalize(F.col("vec")))


def partition_faults(part: Partition, k: int) -> DataFrame:
    """One row that counts what is wrong with a partition."""
    labels = part.labels.agg(F.countDistinct("region").alias("n_regions"), F.count_if(~F.col("region").between(0, k - 1)).alias("out_of_range"), (F.count("id") - F.countDistinct("id")).alias("repeated_ids"))
    protos = part.prototypes.agg((F.lit(k) - F.countDistinct("owner")).alias("unowned"), F.count_if(~F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("not_finite"))
    scale = part.stats.agg(F.count_if(F.exists("scale", lambda s: s <= 0)).alias("bad_scale"))
    return labels.crossJoin(protos).crossJoin(scale)  # one row each


def validate_partition(part: Partition, k: int) -> Partition:
    """The partition, or ValueError."""
    row = partition_faults(part, k).first().asDict()
    if row.pop("n_regions") != k or any(row.values()):
        raise ValueError(f"partition is not valid: {row}")
    return part


def fit_partition(df: DataFrame, method: str, k: int = 3, seed: int = 0, **settings) -> Partition:
    """One of the methods, checked."""
    fits = {"global": lambda: fit_global(df), "random_voronoi": lambda: fit_random_voronoi(df, k, seed), "kmeanspp": lambda: fit_kmeans(df, k, seed, **settings), "spectral": lambda: fit_spectral(df, k, seed, **settings), "auto": lambda: fit_auto(df, k, **settings)}
    if method not in fits:
        raise ValueError(f"method is one of {sorted(fits)}")
    part = fits[method]()
    return validate_partition(part, 1 if part.meta["method"] == "global" else k)
