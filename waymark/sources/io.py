"""Sources and sinks: frame tables, latent caches, partition artifacts, run results, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.common import is_finite


#: Row ids that a scan is given one by one; more are given as their range.
LISTED_IDS = 1000


def read_frames(spark: SparkSession, path: str, cols: list[str], ids: DataFrame | None = None, id_col: str = "frame_id") -> DataFrame:
    """Only the named columns that exist, at given row ids if there are any.

    The ids reach the scan as a list or as their range, which skips files and
    row groups by their bounds; what is left is joined.
    """
    df = spark.read.parquet(path)
    df = df.select(*[c for c in cols if c in df.columns])
    if ids is None:
        return df
    ids = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    some = [r[0] for r in ids.limit(LISTED_IDS + 1).collect()]
    if len(some) <= LISTED_IDS:
        return df.where(F.col(id_col).isin(some))
    low, high = ids.agg(F.min(id_col), F.max(id_col)).first()
    return df.where(F.col(id_col).between(low, high)).join(ids, id_col, "left_semi")


def resolve_state_key(df: DataFrame, candidates: list[str], requested: str | None = None) -> str:
    """The requested column, which must exist, or else the first candidate that does."""
    if requested is not None:
        if requested not in df.columns:
            raise KeyError(f"no column {requested}")
        return requested
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {candidates} is a column")


def read_latent_cache(spark: SparkSession, path: str, history: int, preds: int, route_index: int = 0) -> DataFrame:
    """S3: the cache at ``path`` after its contract checks."""
    return check_latent_cache(spark.read.parquet(path), history, preds, route_index)


def cache_contract(cache: DataFrame, slots: int, route_index: int = 0) -> DataFrame:
    """One row that counts what breaks the contract of a cache (start, emb, act_emb)."""
    route = F.get("emb", F.lit(route_index))
    dims = F.size(F.get("emb", F.lit(0)))
    return cache.agg(
        F.count("*").alias("n_rows"),
        F.count_if((F.size("emb") != slots) | (F.size("act_emb") != slots)).alias("bad_slots"),
        (F.max(dims) - F.min(dims)).cast("long").alias("dim_spread"),
        F.count_if(F.exists("emb", lambda v: F.size(v) != dims)).alias("bad_dims"),
        F.count_if(~F.forall(route, is_finite)).alias("not_finite"),
        (F.count("start") - F.countDistinct("start")).alias("repeated_starts"),
    )


def check_latent_cache(cache: DataFrame, history: int, preds: int, route_index: int = 0) -> DataFrame:
    missing = {"start", "emb", "act_emb"} - set(cache.columns)
    if missing:
        raise KeyError(f"cache lacks {sorted(missing)}")
    row = cache_contract(cache, history + preds, route_index).first().asDict()
    wrong = {k: v for k, v in row.items() if k != "n_rows" and v}
    if wrong:
        raise ValueError(f"cache breaks its contract: {wrong}")
    return cache


def write_cache(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Whole or not at all; an existing target is an error unless overwriting was asked for."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def merge_cache_shards(shards: list[DataFrame], expected: DataFrame | None = None) -> DataFrame:
    """The union of shards; their starts must be the expected pool exactly, each once."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    if expected is not None:
        have, want = out.select("start"), expected.select("start")
        if have.exceptAll(want).limit(1).count() or want.exceptAll(have).limit(1).count():
            raise ValueError("shards don't cover the expected starts exactly")
    return out


def write_artifact(path: str, prototypes: DataFrame, norm_params: DataFrame, meta: dict) -> None:
    """Prototypes (idx, vec, owner), norm_params (mean, scale) and metadata, with the prototypes' hash."""
    spark = prototypes.sparkSession
    digest = prototypes.select(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.to_json(F.struct("idx", "vec", "owner"))))), 256)).first()[0]  # K * P rows
    prototypes.write.parquet(f"{path}/prototypes")
    norm_params.write.parquet(f"{path}/norm_params")
    spark.createDataFrame([(json.dumps(meta | {"prototypes_sha256": digest}, sort_keys=True),)], "json string").write.parquet(f"{path}/meta")


def read_artifact(spark: SparkSession, path: str, legacy_eps: float | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """The three parts; a recorded hash is checked.  ``legacy_eps`` is added to scales that were stored without it."""
    prototypes, params = spark.read.parquet(f"{path}/prototypes"), spark.read.parquet(f"{path}/norm_params")
    if "sigma" in params.columns:
        params = params.select("mean", F.transform("sigma", lambda x: x + F.lit(legacy_eps or 0.0)).alias("scale"))
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    digest = prototypes.select(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.to_json(F.struct("idx", "vec", "owner"))))), 256)).first()[0]
    if meta.get("prototypes_sha256", digest) != digest:
        raise ValueError("prototypes differ from the recorded hash")
    return prototypes, params, meta


def resolve_cluster_source(artifact: str | None = None, labels: str | None = None) -> tuple[str, str]:
    """Exactly one of an artifact folder and a label table."""
    if (artifact is None) == (labels is None):
        raise ValueError("give an artifact or labels, not both or neither")
    return ("artifact", artifact) if artifact is not None else ("labels", labels)


RUN_SCHEMA = "metrics struct<success_rate: double>, seed long, num_eval long, goal_offset_steps long, eval_budget long, eval_start_indices array<long>"


def collect_runs(spark: SparkSession, glob: str, **expected) -> DataFrame:
    """Run results, one JSON file each, flat and checked against ``expected`` settings."""
    return check_runs(flat_runs(spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(glob)), **expected)


def flat_runs(raw: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), F.col("metrics.success_rate").alias("success_rate"), "seed", "num_eval", "goal_offset_steps", "eval_budget", F.col("eval_start_indices").alias("starts"))


def check_runs(runs: DataFrame, **expected) -> DataFrame:
    """Rates lie in [0, 100] and settings are as expected, or it is an error."""
    bad = ~F.coalesce(F.col("success_rate").between(0, 100), F.lit(False))
    for k, v in expected.items():
        bad = bad | ~F.col(k).eqNullSafe(F.lit(v))
    if runs.where(bad).limit(1).count():
        raise ValueError("a run result has a bad rate or other settings than expected")
    return runs


def seed_of_path(path: Column) -> Column:
    """The number after "seed" in the last folder or file that has one."""
    return F.regexp_extract(path, r"seed[_-]?(\d+)[^/]*(?:/[^/]*)?$", 1).try_cast("long")


def read_summaries(spark: SparkSession, glob: str, value: str = "success_rate") -> DataFrame:
    """CSV summaries; the seed is `seed`, else `eval_seed`, else the path's; bad numbers are null; a repeated seed is an error."""
    raw = spark.read.option("header", True).csv(glob)
    own = [F.col(c).try_cast("long") for c in ("seed", "eval_seed") if c in raw.columns]
    out = raw.select(F.coalesce(*own, seed_of_path(F.col("_metadata.file_path"))).alias("seed"), F.col(value).try_cast("double").alias(value))
    if out.groupBy("seed").count().where("count > 1").limit(1).count():
        raise ValueError("a seed occurs twice")
    return out


def write_csv(df: DataFrame, path: str) -> bool:
    """Header and rows; nothing is written without rows."""
    if df.isEmpty():
        return False
    df.write.option("header", True).csv(path)
    return True


def import_npz(spark: SparkSession, glob: str, keys: list[str]) -> DataFrame:
    """Rows (path, row, key, value) of dense arrays in NPZ files, read by the executors."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    for k in keys:
                        a = z[k].reshape(len(z[k]), -1).astype(float)
                        yield pd.DataFrame({"path": path, "row": range(len(a)), "key": k, "value": list(a)})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, row long, key string, value array<double>")


def write_metrics(df: DataFrame, path: str) -> None:
    """Long metric rows, one folder for each horizon and support."""
    df.write.partitionBy("horizon", "anchor_support").parquet(path)


def emit_report(spark: SparkSession, metrics: dict) -> DataFrame:
    """Counts and settings of a run as one row, names in order."""
    return spark.createDataFrame([(json.dumps(metrics, sort_keys=True, separators=(",", ":")),)], "report string")


def merge_region_results(old: DataFrame, updates: DataFrame, config_hash: str, key: str = "region") -> DataFrame:
    """An update wins its key, the others stay; results of another configuration are an error."""
    both = old.select("config_hash").unionByName(updates.select("config_hash"))
    if both.where(~F.col("config_hash").eqNullSafe(F.lit(config_hash))).limit(1).count():
        raise ValueError("results of another configuration")
    return old.join(updates, key, "left_anti").unionByName(updates)
