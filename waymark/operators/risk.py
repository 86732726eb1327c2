"""Region-conditioned risk (K1-K8).  Losses are long rows (start, region, model, loss), model -1 the global one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.common import global_rank, materialize

GLOBAL = -1


def expert_losses(losses: DataFrame, k: int) -> DataFrame:
    """K1: per anchor the global loss, the own region's, and the mean and least of the other regions' models; needs k >= 2."""
    if k < 2:
        raise ValueError("wrong models need at least two regions")
    own, other = F.col("model") == F.col("region"), (F.col("model") != F.col("region")) & (F.col("model") != GLOBAL)
    pick = lambda f, c: f(F.when(c, F.col("loss")))
    keys = [c for c in ("seed", "horizon", "anchor_support", "episode") if c in losses.columns]
    return losses.groupBy(*keys, "start", "region").agg(pick(F.avg, F.col("model") == GLOBAL).alias("global_mse"), pick(F.avg, own).alias("correct_mse"), pick(F.avg, other).alias("wrong_mean_mse"), pick(F.min, other).alias("wrong_best_mse"))


MSE = ("global_mse", "correct_mse", "wrong_mean_mse", "wrong_best_mse")


def region_metrics(samples: DataFrame, k: int, min_episodes: int = 5, min_anchors: int = 1000) -> DataFrame:
    """K2: a row per region, empty ones included: counts, weight, losses, gain, penalty, low_support."""
    per = samples.groupBy("region").agg(F.countDistinct("episode").alias("num_episodes"), F.count("*").alias("num_anchors"), *[F.avg(c).alias(c) for c in MSE])
    every = samples.sparkSession.range(k).withColumnRenamed("id", "region").join(per, "region", "left").fillna(0, ["num_episodes", "num_anchors"])
    gain = F.col("global_mse") - F.col("correct_mse")
    return every.withColumns(
        {
            "region_weight": F.col("num_anchors") / F.sum("num_anchors").over(Window.partitionBy()),
            "global_minus_correct": gain,
            "relative_gain": F.try_divide(gain, F.col("global_mse")),
            "wrong_penalty": F.col("wrong_mean_mse") - F.col("correct_mse"),
            "low_support": (F.col("num_episodes") < min_episodes) | (F.col("num_anchors") < min_anchors),
        }
    )


def weighted_summary(regions: DataFrame) -> DataFrame:
    """K3: one row of weighted losses over the regions with weight, their weights renormalised, and the number of empty ones."""
    w = F.when(F.col("region_weight") > 0, F.col("region_weight"))
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    one = regions.agg(*[mean(c).alias(c) for c in MSE], F.count_if(F.coalesce(F.col("region_weight"), F.lit(0.0)) <= 0).alias("num_empty_regions"))
    return one.withColumns({"global_minus_correct": F.col("global_mse") - F.col("correct_mse"), "relative_gain": F.try_divide(F.col("global_mse") - F.col("correct_mse"), F.col("global_mse"))})


def episode_metrics(samples: DataFrame) -> DataFrame:
    """K4: mean losses per seed, horizon, support and episode."""
    keys = [c for c in ("seed", "horizon", "anchor_support") if c in samples.columns]
    return samples.groupBy(*keys, "episode").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in MSE])


def _draw(rep: F.Column, slot: F.Column, seed: int, n: F.Column) -> F.Column:
    """A reproducible index in [0, n)."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), slot.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(u, n)


def paired_bootstrap(blocks: DataFrame, reps: int, seed: int, a: str = "global_mse", b: str = "correct_mse", key: str = "i") -> DataFrame:
    """K5: (estimate, low, high) of the mean of a - b: all arms share a resample; 2.5 and 97.5 % of the resampled means.

    A resample is drawn and summed in one task, so only its mean is shuffled.
    """
    nth = materialize(global_rank(blocks.select(F.col(key).alias("_key"), (F.col(a) - F.col(b)).alias("d")), ["_key"], "_r").select((F.col("_r") - 1).cast("long").alias("at"), "d"))
    means = _draws(nth.sparkSession, nth.count(), reps, seed).join(nth, "at").groupBy("rep").agg(F.avg("d").alias("m"))
    ci = means.agg(F.percentile("m", [0.025, 0.975]).alias("q"))
    return nth.agg(F.avg("d").alias("estimate")).crossJoin(ci).select("estimate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def _draws(spark: SparkSession, n: int, reps: int, seed: int) -> DataFrame:
    """(rep, at): the n numbers below n that each resample draws; resamples are dealt to tasks, and sums by them are whole before they move."""
    slot = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("slot")
    tasks = max(1, min(reps, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, reps if n else 0, 1, tasks).select(F.col("id").alias("rep"), slot).select("rep", _draw(F.col("rep"), F.col("slot"), seed, F.lit(max(n, 1))).alias("at"))


def nested_bootstrap(samples: DataFrame, reps: int, seed: int, a: str = "global_mse", b: str = "correct_mse") -> DataFrame:
    """K6: seeds are redrawn, then one draw of episodes that all seeds share; the mean of per-seed means.

    Rows are summed per (seed, episode) first; draws of episodes meet these sums, and what is shuffled is a row per resample and seed.
    """
    spark = samples.sparkSession
    cells = materialize(samples.groupBy("seed", "episode").agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count("*").alias("c")))
    numbered = lambda name: materialize(global_rank(cells.select(name).distinct(), [name], "_r").select(name, (F.col("_r") - 1).cast("long").alias("at")))
    seeds, episodes = numbered("seed"), numbered("episode")
    ts = _draws(spark, seeds.count(), reps, seed).groupBy("rep", "at").agg(F.count("*").alias("ks")).join(seeds, "at").drop("at")
    of = cells.join(episodes, "episode").select("at", "seed", "s", "c")
    per = _draws(spark, episodes.count(), reps, seed + 1).join(of, "at").groupBy("rep", "seed").agg((F.sum("s") / F.sum("c")).alias("m"))
    means = per.join(ts, ["rep", "seed"]).groupBy("rep").agg((F.sum(F.col("ks") * F.col("m")) / F.sum("ks")).alias("m"))
    point = cells.groupBy("seed").agg((F.sum("s") / F.sum("c")).alias("m")).agg(F.avg("m").alias("estimate"))
    return point.crossJoin(means.agg(F.percentile("m", [0.025, 0.975]).alias("q"))).select("estimate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def success_blocks(runs: DataFrame, a: str, b: str) -> DataFrame:
    """K7: (i, a, b): success rates per (train seed, eval seed) after averaging partition seeds, methods side by side."""
    per = runs.groupBy("method", "train_seed", "eval_seed").agg(F.avg("success_rate").alias("rate"))
    pick = lambda m, n: per.where(F.col("method") == m).select("train_seed", "eval_seed", F.col("rate").alias(n))
    return pick(a, "a").join(pick(b, "b"), ["train_seed", "eval_seed"]).withColumn("i", F.struct("train_seed", "eval_seed"))


def success_bootstrap(runs: DataFrame, a: str, b: str, reps: int, seed: int) -> DataFrame:
    """K7: the paired interval of the difference of two methods."""
    return paired_bootstrap(success_blocks(runs, a, b), reps, seed, "a", "b")


def metric_records(losses: DataFrame, k: int) -> dict[str, DataFrame]:
    """K8: sample, episode, region and summary rows of a loss matrix."""
    samples = expert_losses(losses, k)
    regions = region_metrics(samples, k)
    return {"samples": samples, "episodes": episode_metrics(samples), "regions": regions, "summary": weighted_summary(regions)}
