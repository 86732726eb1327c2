"""Predictors per region and rollouts.

The built-in model is linear ridge regression on the concatenated history of
latents and actions; other trainers and scorers plug in as functions.  A model
table is (seed, region, coef ARRAY<DOUBLE>), row-major [inputs + 1, outputs].
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.common import materialize
from waymark.operators.sampling import holdout
from waymark.operators.vectors import moments_by

MIN_ROWS = 256
#: Rows of a region that a trainer may get, as one task holds them.
TRAINER_MOST = 5_000_000


def training_rows(cache: DataFrame, history: int = 1) -> DataFrame:
    """(start, x, y): flattened history of [latent, action] and the slot after it, from a cache (start, emb, act_emb); windows that end before that slot have no target."""
    x = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(history - 1)), lambda k: F.concat(F.get("emb", k), F.get("act_emb", k))))
    return cache.where(F.size("emb") > history).select("start", F.transform(x, lambda v: v.cast("double")).alias("x"), F.transform(F.get("emb", F.lit(history)), lambda v: v.cast("double")).alias("y"))


def ridge(n: float, c: np.ndarray, d: int, penalty: float) -> np.ndarray:
    """Coefficients from cross products of [x, 1, y]; the intercept is not penalised."""
    reg = penalty * n * np.eye(d)
    reg[-1, -1] = 0
    return np.linalg.lstsq(c[:d, :d] + reg, c[:d, d:], rcond=None)[0]


def fit_regional(rows: DataFrame, labels: DataFrame, k: int, penalty: float = 1e-6, seed: int = 0, on_small: str = "error", trainer: Callable | None = None) -> DataFrame:
    """M1: (seed, region, coef, n), one model per region of (start, x, y) rows.

    Labels out of 0..k-1 and regions below MIN_ROWS are errors, or small ones
    are skipped.  The Gram sums of each region are partial matrices per task; a
    ``trainer`` (pdf -> coef) gets a region's rows instead, in one task, so more
    than TRAINER_MOST of them are an error.
    """
    if labels.where(~F.col("region").between(0, k - 1)).limit(1).count():
        raise ValueError("a label is out of range")
    own = materialize(rows.join(labels.select(F.col("id").alias("start"), "region"), "start"))
    sizes = {r["region"]: r["count"] for r in own.groupBy("region").count().collect()}  # at most k rows
    small = [r for r in range(k) if sizes.get(r, 0) < MIN_ROWS]
    if small and on_small != "skip":
        raise ValueError(f"regions {small} have fewer than {MIN_ROWS} rows")
    spark, out = rows.sparkSession, []
    if trainer is not None:
        if max(sizes.values(), default=0) > TRAINER_MOST:
            raise ValueError(f"a region has more than {TRAINER_MOST} rows for its trainer")
        fit = lambda key, pdf: pd.DataFrame({"seed": [seed], "region": [key[0]], "coef": [np.asarray(trainer(pdf)).ravel().tolist()], "n": [len(pdf)]})
        return own.where(~F.col("region").isin(small) if small else F.lit(True)).groupBy("region").applyInPandas(fit, "seed long, region long, coef array<double>, n long")
    names = {f"_r{r}": r for r in range(k) if r not in small}
    if not names:
        return spark.createDataFrame([], "seed long, region long, coef array<double>, n long")
    one = own.select(F.concat("x", F.array(F.lit(1.0))).alias("x"), "y", *[(F.col("region") == r).cast("double").alias(name) for name, r in names.items()])
    sums = moments_by(one, ["x", "y"], list(names))
    d = len(own.select("x").first()[0]) + 1
    for name, r in names.items():
        n, _, c = sums[name]
        out.append((seed, r, [float(v) for v in ridge(n, c, d, penalty).ravel()], int(n)))
    return spark.createDataFrame(out, "seed long, region long, coef array<double>, n long")


def fit_models(rows: DataFrame, labels: DataFrame | None, k: int = 1, **settings) -> DataFrame:
    """M2: the global model is the same fit with one region."""
    if labels is None:
        labels, k = rows.select(F.col("start").alias("id"), F.lit(0).alias("region")), 1
    return fit_regional(rows, labels, k, **settings)


def load_models(models: DataFrame, seed: int, k: int) -> dict[int, np.ndarray]:
    """Region -> coefficients of a seed; a missing one is an error."""
    found = {r["region"]: np.array(r["coef"]) for r in models.where(F.col("seed") == seed).collect()}  # K + 1 rows
    if set(range(k)) - set(found):
        raise ValueError("a model is missing")
    return found


def one_step_losses(rows: DataFrame, models: dict[int, np.ndarray]) -> DataFrame:
    """M4: (start, model, loss), the mean squared error of each model on each row, long."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy())
            x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
            for m, coef in models.items():
                yield pd.DataFrame({"start": pdf["start"], "model": m, "loss": ((x @ coef.reshape(x.shape[1], -1) - y) ** 2).mean(axis=1)})

    return rows.select("start", "x", "y").mapInPandas(score, "start long, model long, loss double")


def predictor_loss(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """M3: the sum of squared errors over the number of elements."""
    return one_step_losses(rows, {0: model}).agg(F.avg("loss").alias("loss"))


def rollout_inputs(cache: DataFrame, anchors: DataFrame, horizon: int, frameskip: int = 1) -> DataFrame:
    """(start, first, actions, truth): what a rollout of ``horizon`` steps needs, one row per anchor."""
    own = cache.select(F.col("start").alias("at"), F.get("emb", F.lit(0)).alias("z"), F.get("act_emb", F.lit(0)).alias("a"))
    need = anchors.select("start", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("k")).withColumn("at", F.col("start") + F.col("k") * frameskip)
    got = need.join(own, "at").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("k", "z", "a"))).alias("s")).where(F.size("s") == horizon + 1)
    pick = lambda c: F.transform("s", lambda x: F.transform(x[c], lambda v: v.cast("double")))
    return got.select("start", F.get(pick("z"), F.lit(0)).alias("first"), F.slice(pick("a"), 1, horizon).alias("actions"), F.slice(pick("z"), 2, horizon).alias("truth"))


def switch_rollout(inputs: DataFrame, models: dict[int, np.ndarray], keys: str | Callable = "region", name: str = "model") -> DataFrame:
    """M5, M6, M7: (start, step, key, loss, pred): own predictions fed back with recorded actions, one long row per step.

    ``keys`` is a column with the model of every row (or an array, one per
    step), or a function of a batch of latents that routes each step anew.  One
    run at the longest horizon serves all: shorter ones are filters.
    """
    col = keys if isinstance(keys, str) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.stack(pdf["first"].to_numpy())
            actions = np.stack([np.stack(a) for a in pdf["actions"]])
            truth = np.stack([np.stack(t) for t in pdf["truth"]])
            for step in range(actions.shape[1]):
                if col is None:
                    key = np.asarray(keys(z))
                else:
                    own = pdf[col].to_numpy()
                    key = np.array([k[step] if np.ndim(k) else k for k in own])
                x = np.concatenate((z, actions[:, step], np.ones((len(z), 1))), axis=1)
                new = np.empty_like(z)
                for m in np.unique(key):
                    at = key == m
                    new[at] = x[at] @ models[int(m)].reshape(x.shape[1], -1)
                z = new
                yield pd.DataFrame({"start": pdf["start"], "step": step + 1, name: key, "loss": ((z - truth[:, step]) ** 2).mean(axis=1), "pred": list(z)})

    return inputs.mapInPandas(run, f"start long, step int, {name} long, loss double, pred array<double>")


def rollout_losses(inputs: DataFrame, models: dict[int, np.ndarray], horizons: list[int]) -> DataFrame:
    """M5: (start, model, horizon, terminal, mean_loss) of every model on every anchor."""
    per = None
    for m in models:
        one = switch_rollout(inputs.withColumn("_m", F.lit(m)), models, "_m")
        per = one if per is None else per.unionByName(one)
    long = per.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).where("step <= horizon")
    return long.groupBy("start", "model", "horizon").agg(F.max_by("loss", "step").alias("terminal"), F.avg("loss").alias("mean_loss"))


def rollout_deviation(a: DataFrame, b: DataFrame) -> DataFrame:
    """M8: per step the mean and population SD of both losses and of the distance between two rollouts."""
    both = a.select("start", "step", F.col("loss").alias("la"), F.col("pred").alias("pa")).join(b.select("start", "step", F.col("loss").alias("lb"), F.col("pred").alias("pb")), ["start", "step"])
    gap = F.aggregate(F.zip_with("pa", "pb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("pa")
    both = both.withColumn("gap", gap)
    return both.groupBy("step").agg(*[f(c).alias(f"{n}_{t}") for c, n in (("gap", "pairwise"), ("la", "a"), ("lb", "b")) for f, t in ((F.avg, "mean"), (F.stddev_pop, "sd"))])


def rollout_summary(losses: DataFrame, region: str = "region") -> DataFrame:
    """M9: mean, population SD and rows per step and region, and over all regions (region null)."""
    return losses.groupingSets([["step", region], ["step"]], "step", region).agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("sd"), F.count("*").alias("n"))


def delta_vs(losses: DataFrame, reference: str) -> DataFrame:
    """Per variant and step the mean and population SD of the difference to the reference, and the shares improved and worse."""
    ref = losses.where(F.col("variant") == reference).select("start", "step", F.col("loss").alias("_r"))
    d = losses.where(F.col("variant") != reference).join(ref, ["start", "step"]).withColumn("_d", F.col("loss") - F.col("_r"))
    share = lambda c: F.avg(c.cast("double"))
    return d.groupBy("variant", "step").agg(F.avg("_d").alias("mean_delta"), F.stddev_pop("_d").alias("sd_delta"), share(F.col("_d") < 0).alias("improved"), share(F.col("_d") > 0).alias("worse"))


def rule_drift(rows: DataFrame, splits: list[str], reference: str, penalty: float = 1e-6) -> DataFrame:
    """Relative Frobenius distance of each split's fitted map to the reference's; a linear model's coefficients are its Jacobian."""
    out, base = [], None
    d = len(rows.select("x").first()[0]) + 1
    one = rows.withColumn("x", F.concat("x", F.array(F.lit(1.0))))
    names = [reference, *[x for x in splits if x != reference]]
    sums = moments_by(one.select("x", "y", *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in names]), ["x", "y"], names)
    for s in names:
        n, _, c = sums[s]
        if n < d:
            continue
        jac = ridge(n, c, d, penalty)[:-1]
        base = jac if base is None else base
        out.append((s, int(n), float(np.linalg.norm(jac - base) / max(np.linalg.norm(base), 1e-12))))
    return rows.sparkSession.createDataFrame(out, "split string, n long, drift double")


def compare_heldout(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per horizon the difference and ratio of two models' terminal and mean losses (start, horizon, terminal, mean_loss)."""
    both = a.select("start", "horizon", F.col("terminal").alias("ta"), F.col("mean_loss").alias("ma")).join(b.select("start", "horizon", F.col("terminal").alias("tb"), F.col("mean_loss").alias("mb")), ["start", "horizon"])
    return both.groupBy("horizon").agg(F.count("*").alias("n"), (F.avg("tb") - F.avg("ta")).alias("terminal_delta"), F.try_divide(F.avg("tb"), F.avg("ta")).alias("terminal_ratio"), (F.avg("mb") - F.avg("ma")).alias("mean_delta"), F.try_divide(F.avg("mb"), F.avg("ma")).alias("mean_ratio"))


def one_step_by_run(rows: DataFrame, runs: dict[str, dict[int, np.ndarray]], frac: float = 0.2, seed: int = 0) -> DataFrame:
    """(run, model, mean, sd, n) of one-step losses on a fixed holdout."""
    held, out = materialize(holdout(rows, frac, seed, "start")), None
    for name, models in runs.items():
        one = one_step_losses(held, models).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("run", "model").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("sd"), F.count("*").alias("n"))


def encode_frames(keys: DataFrame, frames: DataFrame, encode: Callable[[np.ndarray], np.ndarray], col: str = "state") -> DataFrame:
    """(key, vec): a user's batch scorer on each distinct frame once; it must return a vector per row."""

    @F.pandas_udf("array<double>")
    def score(v: pd.Series) -> pd.Series:
        out = np.asarray(encode(np.stack([np.asarray(x, dtype=np.float64) for x in v])))
        if len(out) != len(v):
            raise ValueError("the scorer dropped rows")
        return pd.Series(list(out))

    return keys.join(frames.select("frame_id", col), "frame_id").select("key", score(F.col(col)).alias("vec"))


def select_best(history: DataFrame) -> DataFrame:
    """Per region the iteration of the least evaluation loss; the earliest on ties."""
    return history.groupBy("region").agg(F.min_by("iteration", F.struct("eval_loss", "iteration")).alias("iteration"), F.min("eval_loss").alias("eval_loss"))


def routed_losses(losses: DataFrame, regions: DataFrame) -> DataFrame:
    """(start, region, model, loss) with each row's own region."""
    return losses.join(regions.select(F.col("id").alias("start"), "region"), "start")

