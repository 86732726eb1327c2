"""Composite jobs (J1-J12): chains of the operators, each a function of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.common import materialize, uniform
from waymark.operators import agreement, audit, graph, models, partition, risk, routing, sampling, vectors, windows


def run_drift(rows: DataFrame, masks: list[str], reference: str, trials: int = 5, share: float = 0.5, seed: int = 0, id_col: str = "id", **cols) -> DataFrame:
    """Alignment drift of each mask (rows with latent, state and boolean columns), with excess and z over random subsets."""
    found = agreement.drift_metrics(rows, masks, reference, **cols)
    boot = agreement.iid_drift(rows, reference, trials, share, seed, id_col, **cols)
    return agreement.add_excess(found, boot, "drift")


def run_rule_drift(cache: DataFrame, masks: DataFrame, names: list[str], reference: str, history: int = 1) -> DataFrame:
    """Drift of the fitted dynamics of each mask (start and boolean columns) from the reference's."""
    return models.rule_drift(materialize(models.training_rows(cache, history).join(masks, "start")), names, reference)


def run_probe(latents: DataFrame, fractions: dict[str, float], seeds: list[int], kinds: tuple = ("linear", "rff")) -> tuple[DataFrame, DataFrame]:
    """Probes of (id, latent, label, ep) on an episode split per seed: (per run, summary of the test split)."""
    out = None
    for seed in seeds:
        split = materialize(sampling.episode_split3(latents, fractions, seed))
        for kind in kinds:
            one = agreement.probe(split, kind, seed=seed).select(F.lit(kind).alias("model"), F.lit(seed).alias("seed"), "*")
            out = one if out is None else out.unionByName(one)
    out = materialize(out)
    return out, agreement.probe_summary(out.where("split = 'test'"))


def run_rollouts(cache: DataFrame, anchors: DataFrame, variants: dict[str, tuple], horizon: int, reference: str) -> tuple[DataFrame, DataFrame]:
    """Rollouts of named (models, keys) on one set of anchors: (summary per variant and step, difference to the reference)."""
    inputs, out = materialize(models.rollout_inputs(cache, anchors, horizon)), None
    for name, (fitted, keys) in variants.items():
        rows = inputs if isinstance(keys, str) or callable(keys) else inputs.join(keys, "start")
        one = models.switch_rollout(rows, fitted, keys if isinstance(keys, str) or callable(keys) else "region").select(F.lit(name).alias("variant"), "start", "step", "loss")
        out = one if out is None else out.unionByName(one)
    out = materialize(out)
    summary = out.groupBy("variant", "step").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("sd"), F.count("*").alias("n"))
    return summary, models.delta_vs(out, reference)


def run_regional(cache: DataFrame, labels: DataFrame, k: int, train: DataFrame | None = None, history: int = 1, starts_only: bool = False, **settings) -> DataFrame:
    """A model per region, or only the pools of starts; ``train`` cuts them to a split."""
    pool = labels if train is None else labels.join(train.select(F.col("start").alias("id")), "id", "left_semi")
    return pool if starts_only else models.fit_regional(models.training_rows(cache, history), pool, k, **settings)


def run_preprocess_stability(latents: DataFrame, names: list[str], k: int, seeds: list[int], niter: int = 25, rel_tol: float | None = None) -> tuple[DataFrame, DataFrame]:
    """K-means of each preparation and seed: (pairwise ARI and NMI, summary per preparation)."""
    pairs = None
    for name in names:
        z, runs = materialize(vectors.preprocess(latents, name).select("id", "z")), None
        for seed, (centres, _) in zip(seeds, partition.spherical_kmeans_runs(z, k, seeds, niter, rel_tol=rel_tol), strict=True):
            one = routing.nearest_owner(z, partition.centroid_table(z.sparkSession, centres)).select(F.lit(seed).alias("seed"), "id", F.col("region").alias("label"))
            runs = one if runs is None else runs.unionByName(one)
        p = agreement.pairwise_stability(materialize(runs)).select(F.lit(name).alias("variant"), "*")
        pairs = p if pairs is None else pairs.unionByName(p)
    pairs = materialize(pairs)
    return pairs, pairs.groupBy("variant").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"), F.avg("nmi").alias("mean_nmi"))


def run_restart_budget(z: DataFrame, k: int, outer: list[int], restarts: int, budgets: list[int], niter: int = 25) -> tuple[DataFrame, DataFrame]:
    """Objectives of all restarts, and how far each budget's best is from the best of all."""
    keys = [(o, r) for o in outer for r in range(restarts)]
    fits = partition.spherical_kmeans_runs(z, k, [o * 100_000 + r for o, r in keys], niter)
    rows = [(o, r, told[-1]) for (o, r), (_, told) in zip(keys, fits, strict=True)]
    runs = z.sparkSession.createDataFrame(rows, "outer_seed long, restart long, objective double")
    return runs, agreement.budget_summary(runs, budgets)


def run_partitions(latents: DataFrame, method: str, seeds: list[int], k: int = 3, **settings) -> tuple[dict, DataFrame]:
    """A partition per seed, and the stability of their labels."""
    parts = {s: partition.fit_partition(latents, method, k, s, **settings) for s in seeds}
    runs = None
    for s, p in parts.items():
        one = p.labels.select(F.lit(s).alias("seed"), "id", F.col("region").alias("label"))
        runs = one if runs is None else runs.unionByName(one)
    return parts, agreement.pairwise_stability(materialize(runs))


def run_gate(cache: DataFrame, group: F.Column, frameskip: int = 1, **settings) -> DataFrame:
    """The gate's decision on a cache's unique latents, without fitting a model."""
    unique = windows.dedup_timesteps(windows.expand_latents(cache, frameskip)).select(F.col("ts").alias("id"), "latent").withColumn("grp", group)
    z = materialize(vectors.zscore_l2(unique, vectors.zscore_l2_fit(unique)).select("id", "grp", F.col("z").alias("latent")))
    return graph.evaluate_gate(z, **settings)[1]


def prepare(frames: DataFrame, slots: int, frameskip: int, train_fraction: float = 0.9, seed: int = 0) -> dict[str, DataFrame]:
    """Starts with their split, action statistics of the training starts, the unique-frame index and its counters."""
    starts = materialize(sampling.transition_split(windows.valid_starts(frames, slots, frameskip), train_fraction, seed).select("start", "ep", "split"))
    blocks = windows.gather_action_blocks(starts.where("split = 'train'"), frames, slots - 1, frameskip)
    keys, inverse = windows.unique_frame_index(windows.expand_windows(starts, slots, frameskip))
    return {"starts": starts, "action_stats": windows.action_stats(blocks), "keys": keys, "inverse": inverse, "counters": audit.dedup_stats(inverse)}


def run_formal_risk(cache: DataFrame, episodes: DataFrame, method: str, k: int, seed: int = 0, fraction: float = 0.7, reps: int = 200, **settings) -> dict[str, DataFrame]:
    """Episode split, partition of the training latents, regional and global models, held-out losses, risk tables, interval and audit."""
    starts = cache.select("start").join(episodes, "start")
    split = materialize(sampling.episode_split(starts, fraction, seed))
    train, held = split.where("split = 'train'").select("start", "ep"), split.where("split = 'eval'").select("start", "ep")
    latents = cache.select(F.col("start").alias("id"), F.get("emb", F.lit(0)).alias("latent")).join(starts.select(F.col("start").alias("id"), F.col("ep").alias("grp")), "id")
    part = partition.fit_partition(materialize(latents.join(train.select(F.col("start").alias("id")), "id", "left_semi")), method, k, seed, **settings)
    rows = materialize(models.training_rows(cache))
    fit_rows = rows.join(train.select("start"), "start", "left_semi")
    regional = models.load_models(models.fit_regional(fit_rows, part.labels, k, on_small="error"), 0, k)
    overall = models.load_models(models.fit_models(fit_rows, None), 0, 1)[0]
    routed = materialize(partition.replay_artifact(latents.join(held.select(F.col("start").alias("id")), "id", "left_semi"), part))
    losses = models.one_step_losses(rows.join(held.select("start"), "start", "left_semi"), {risk.GLOBAL: overall, **regional})
    full = models.routed_losses(losses, routed).join(held.select("start", F.col("ep").alias("episode")), "start").withColumn("seed", F.lit(seed))
    records = risk.metric_records(materialize(full), k)
    return records | {"interval": risk.nested_bootstrap(records["samples"], reps, seed), "audit": audit.audit_disjoint(train, held, required=True)}


def compare_protocols(a: DataFrame, b: DataFrame) -> DataFrame:
    """Settings, counts and hashes (key, value) of two runs, field by field: equal, and on which side a field is missing."""
    both = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full_outer")
    return both.withColumns({"equal": F.col("a").eqNullSafe(F.col("b")), "missing": F.when(F.col("a").isNull(), "a").when(F.col("b").isNull(), "b")})


def split_masks(rows: DataFrame, names: list[str], seed: int, id_col: str = "id") -> DataFrame:
    """Boolean columns of random halves, for drift jobs without region masks."""
    return rows.withColumns({n: uniform(seed + i, id_col) < 0.5 for i, n in enumerate(names)})
