"""Registered queries of the composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.common import materialize
from waymark.plans import jobs
from waymark.plans.data import FRAMES, cache, frames, latents, table
from waymark.plans.registry import query


@query("j1_alignment_drift")
def _(spark, d):
    lat = latents(spark, d).withColumn("state", F.array(F.col("label").cast("double"), F.get("latent", F.lit(0))))
    return jobs.run_drift(materialize(jobs.split_masks(lat, ["ref", "a", "b"], 3)), ["a", "b"], "ref")


@query("j2_rule_drift")
def _(spark, d):
    own = materialize(cache(spark, d))
    masks = jobs.split_masks(own.select("start"), ["ref", "a"], 5, "start")
    return jobs.run_rule_drift(own, masks, ["a"], "ref")


@query("j3_probe")
def _(spark, d):
    lat = latents(spark, d).withColumns({"ep": F.col("grp"), "label": F.col("label") % 4})
    return jobs.run_probe(lat, {"train": 0.6, "val": 0.2, "test": 0.2}, [0, 1, 2])[0]


@query("j8_partition_stability")
def _(spark, d):
    return jobs.run_partitions(latents(spark, d), "random_voronoi", [1, 2, 3])[1]


@query("j10_preparation", f"WITH {FRAMES}, s AS (SELECT frame_id AS start FROM (SELECT *, lead(frame_id, 15) OVER (PARTITION BY ep ORDER BY step) AS a FROM frames) WHERE a = frame_id + 15), x AS (SELECT start, start + 5 * k AS f FROM (SELECT start, unnest(range(0, 4)) AS k FROM s)) SELECT count(*) AS n_slots, count(DISTINCT f) AS n_keys, count(DISTINCT start) AS n_windows, 1 - count(DISTINCT f) / count(*) AS saved_share, count(*) / count(DISTINCT f) AS reuse FROM x")
def _(spark, d):
    return jobs.prepare(frames(spark, d), 4, 5)["counters"]


@query("j11_formal_risk")
def _(spark, d):
    """The events' frames as latents: windows of two slots, four random regions of two."""
    f = frames(spark, d)
    nxt = f.select((F.col("frame_id") - 1).alias("frame_id"), F.col("state").alias("n"), F.col("action").alias("m"))
    small = f.join(nxt, "frame_id").select(F.col("frame_id").alias("start"), "ep", F.array("state", "n").alias("emb"), F.array("action", "m").alias("act_emb"))
    small = materialize(small)
    return jobs.run_formal_risk(small.drop("ep"), small.select("start", "ep"), "random_voronoi", 2, seed=1)["regions"]


@query("j12_protocol_comparison", "SELECT n_name AS key, n_nationkey::VARCHAR AS a, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey::VARCHAR END AS b, n_nationkey % 4 <> 0 AND n_nationkey = n_regionkey AS equal, CASE WHEN n_nationkey % 4 = 0 THEN 'b' END AS missing FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    return jobs.compare_protocols(n.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")), n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")))
