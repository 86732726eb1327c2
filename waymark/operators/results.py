"""Result aggregation (A1-A10) over runs (method, train_seed, partition_seed, eval_seed, success_rate, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sd(col: str | Column, single: float | None = 0.0) -> Column:
    """Sample SD; ``single`` for one value."""
    return F.when(F.count(col) > 1, F.stddev_samp(col)).otherwise(F.lit(single).cast("double"))


def matrix_summary(runs: DataFrame) -> DataFrame:
    """A1: per method: mean and SD over train seeds of the averages over partition and eval seeds; SD over all values too."""
    per = runs.groupBy("method", "train_seed").agg(F.avg("success_rate").alias("m"))
    top = per.groupBy("method").agg(F.avg("m").alias("mean"), sd("m").alias("sd_train"), F.count("*").alias("n_train"))
    return top.join(runs.groupBy("method").agg(sd("success_rate").alias("sd_all"), F.count("*").alias("n")), "method")


def add_arm(summary: DataFrame, official: DataFrame, runs: DataFrame) -> DataFrame:
    """A2: a further arm's summary; its starts must be the official ones for each eval seed."""
    hashed = lambda df: df.select("eval_seed", F.sha2(F.to_json("starts"), 256).alias("h")).distinct()
    if hashed(runs).exceptAll(hashed(official)).limit(1).count():
        raise ValueError("the arm was evaluated on other starts")
    return summary.unionByName(matrix_summary(runs))


def main_table(runs: DataFrame, expected: int | None = None) -> DataFrame:
    """A3: per method: mean over fine-tuning seeds and SD, null for one seed; the number of runs may be checked."""
    if expected is not None and runs.count() != expected:
        raise ValueError(f"expected {expected} runs")
    per = runs.groupBy("method", "train_seed").agg(F.avg("success_rate").alias("rate"))
    return per.groupBy("method").agg(F.avg("rate").alias("mean"), sd("rate", None).alias("sd"), F.count("*").alias("n_seeds"))


def pairing_audit(runs: DataFrame) -> DataFrame:
    """A4: per eval seed the number of distinct start lists, which should be 1."""
    return runs.groupBy("eval_seed").agg(F.countDistinct(F.sha2(F.to_json("starts"), 256)).alias("n_start_lists")).withColumn("paired", F.col("n_start_lists") == 1)


def check_existing(new: DataFrame, old: DataFrame, keys: list[str], value: str, tol: float = 5e-9) -> DataFrame:
    """A5: rows on one side only or further apart than ``tol``; none means equal."""
    n, o = new.select(*keys, F.col(value).alias("new_value")), old.select(*keys, F.col(value).alias("old_value"))
    apart = F.abs(F.col("new_value") - F.col("old_value")) > tol
    return n.join(o, keys, "full_outer").where(F.col("new_value").isNull() | F.col("old_value").isNull() | apart)


def by_mode(runs: DataFrame, mode: str = "method") -> DataFrame:
    """N, mean, sample SD (0 for one) and the sorted list of values of each mode."""
    return runs.groupBy(mode).agg(F.count("*").alias("n"), F.avg("success_rate").alias("mean"), sd("success_rate").alias("sd"), F.sort_array(F.collect_list("success_rate")).alias("rates"))


def partition_matrix(runs: DataFrame) -> DataFrame:
    """Mean rates by partition and eval seed, with both margins and the total (null keys)."""
    return runs.cube("partition_seed", "eval_seed").agg(F.avg("success_rate").alias("mean"), F.count("*").alias("n"))


def paired_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per eval seed the difference of mean rates; both sides must have the same eval seeds."""
    per = lambda df, n: df.groupBy("eval_seed").agg(F.avg("success_rate").alias(n))
    both = per(a, "a").join(per(b, "b"), "eval_seed", "full_outer")
    if both.where("a IS NULL OR b IS NULL").limit(1).count():
        raise ValueError("eval seeds differ")
    return both.withColumn("diff", F.col("a") - F.col("b"))


def summarize(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean and sample SD (0 for one) of finite values by keys."""
    aggs = []
    for c in cols:
        ok = F.when(~F.isnan(c), F.col(c))
        aggs += [F.avg(ok).alias(f"{c}_mean"), sd(ok).alias(f"{c}_sd")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def joint_summary(splits: list[str], predictor: DataFrame, encoder: DataFrame) -> DataFrame:
    """A row per named split with both sources' values; null where one has none."""
    order = predictor.sparkSession.createDataFrame(list(enumerate(splits)), "ord int, split string")
    return order.join(predictor.select("split", F.col("value").alias("predictor")), "split", "left").join(encoder.select("split", F.col("value").alias("encoder")), "split", "left")


def latency_summary(timings: DataFrame, baseline: str) -> DataFrame:
    """A10: per variant the mean and SD of the first solve of each run in ms per environment, and % over the baseline."""
    first = timings.withColumn("_n", F.row_number().over(Window.partitionBy("variant", "run").orderBy("solve"))).where("_n = 1")
    per = first.withColumn("ms", 1000 * F.col("seconds") / F.col("num_envs")).groupBy("variant").agg(F.avg("ms").alias("ms_mean"), sd("ms").alias("ms_sd"), F.count("*").alias("n"))
    base = per.where(F.col("variant") == baseline).select(F.col("ms_mean").alias("_b"))
    return per.crossJoin(F.broadcast(base)).withColumn("overhead_pct", 100 * (F.col("ms_mean") / F.col("_b") - 1)).drop("_b")
