"""Registered queries that write tables in the formats of S2-S13, read them back and sum them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waymark.functions.common import shared_dir
from waymark.operators import agreement, audit, regions, risk
from waymark.plans.data import LABELINGS, LATENTS, LOSSES, RUNS, labelings, latents, losses, runs, table
from waymark.plans.registry import query
from waymark.sources import io, versions


def _path(spark) -> str:
    return f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"


def r6(c):
    return F.round(c, 6)


@query("s2_state_key", "SELECT event_id, value AS state FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col(io.resolve_state_key(e, ["proprio", "state", "value"])).alias("state"))


@query("s8_label_source", "SELECT label::BIGINT % 4 AS region, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, d):
    path = _path(spark)
    latents(spark, d).select("id", (F.col("label") % 4).alias("region")).write.parquet(path)
    kind, at = io.resolve_cluster_source(labels=path)
    assert kind == "labels"
    return regions.class_counts(spark.read.parquet(at), "region")


@query("s9_collect_runs", f"WITH {RUNS} SELECT eval_seed AS seed, num_eval, round(success_rate, 6) AS success_rate, 25::BIGINT AS goal_offset_steps, 50::BIGINT AS eval_budget, 2::INT AS n_starts, eval_seed * 7 + 1 AS last_start FROM runs")
def _(spark, d):
    """A JSON file for each run, as the runs are stored."""
    path = _path(spark)
    fields = [F.struct("success_rate").alias("metrics"), F.col("eval_seed").alias("seed"), "num_eval", F.lit(25).cast("long").alias("goal_offset_steps"), F.lit(50).cast("long").alias("eval_budget"), F.col("starts").alias("eval_start_indices")]
    runs(spark, d).select(*fields).write.option("maxRecordsPerFile", 1).json(path)
    found = io.collect_runs(spark, f"{path}/*.json", goal_offset_steps=25, eval_budget=50)
    return found.select("seed", "num_eval", r6("success_rate").alias("success_rate"), "goal_offset_steps", "eval_budget", F.size("starts").alias("n_starts"), F.element_at("starts", -1).alias("last_start"))


@query("s10_read_summaries", "SELECT l_suppkey AS seed, CASE WHEN l_suppkey % 7 <> 0 THEN round(100 * avg(l_discount), 4) END AS success_rate FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    path = _path(spark)
    rate = F.round(100 * F.avg("l_discount"), 4).cast("string")
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("eval_seed")).agg(rate.alias("success_rate"))
    assert io.write_csv(per.withColumn("success_rate", F.when(F.col("eval_seed") % 7 == 0, "not run").otherwise(F.col("success_rate"))), path)
    return io.read_summaries(spark, f"{path}/*.csv")


@query("s11_write_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    path = _path(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    assert io.write_csv(n, path) and not io.write_csv(n.limit(0), path + "-none")
    return spark.read.schema(n.schema).option("header", True).csv(path)


@query("s13_write_metrics", f"WITH {LOSSES}, h AS (SELECT *, unnest([1, 5]) AS horizon FROM samples) SELECT horizon::INT AS horizon, 'all' AS anchor_support, region, count(*) AS n, round(sum(correct_mse), 4) AS correct FROM h GROUP BY 1, 2, 3")
def _(spark, d):
    path = _path(spark)
    samples = risk.expert_losses(losses(spark, d), 3).withColumns({"horizon": F.explode(F.array(F.lit(1), F.lit(5))), "anchor_support": F.lit("all")})
    io.write_metrics(samples, path)
    return spark.read.parquet(path).groupBy("horizon", "anchor_support", "region").agg(F.count("*").alias("n"), F.round(F.sum("correct_mse"), 4).alias("correct"))


_REGION = f"{LOSSES}, rg AS (SELECT region, count(*) AS n, avg(global_mse) AS g, avg(correct_mse) AS c FROM samples GROUP BY region)"


@query("k8_metric_records", f"WITH {_REGION} SELECT 'samples' AS record, count(*) AS n, round(avg(global_mse), 6) AS global_mse, round(avg(correct_mse), 6) AS correct_mse FROM samples UNION ALL SELECT 'episodes', count(*), round(avg(g), 6), round(avg(c), 6) FROM (SELECT avg(global_mse) AS g, avg(correct_mse) AS c FROM samples GROUP BY seed, episode) UNION ALL SELECT 'regions', count(*), round(avg(g), 6), round(avg(c), 6) FROM rg UNION ALL SELECT 'summary', 1, round(sum(n * g) / sum(n), 6), round(sum(n * c) / sum(n), 6) FROM rg")
def _(spark, d):
    out = None
    for name, rows in risk.metric_records(losses(spark, d), 3).items():
        one = rows.agg(F.count("*").alias("n"), r6(F.avg("global_mse")).alias("global_mse"), r6(F.avg("correct_mse")).alias("correct_mse")).select(F.lit(name).alias("record"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("r10_class_counts", "SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, d):
    return regions.class_counts(latents(spark, d), "label")


@query("d10_replay_audit", f"WITH {LATENTS} SELECT count(*) AS n, 0::BIGINT AS n_unmatched, count(*) FILTER (WHERE id % 10 = 0) AS n_far FROM lat WHERE label < 5")
def _(spark, d):
    stored = latents(spark, d).select(F.col("id").alias("key"), F.col("latent").alias("vec"), "label")
    again = stored.where("label < 5").select("key", F.transform("vec", lambda x, i: F.when((F.col("key") % 10 == 0) & (i == 3), x + 0.5).otherwise(x)).alias("vec"))
    return audit.replay_audit(stored.drop("label"), again).select("n", "n_unmatched", "n_far")


_CENT = "SELECT label, d, avg(x) AS x FROM labelings JOIN f USING (id) WHERE seed = {} GROUP BY 1, 2"


@query("q4_centroid_cosine", f"WITH {LATENTS}, {LABELINGS}, f AS (SELECT id, unnest(range(1, len(latent) + 1)) AS d, unnest(latent) AS x FROM lat), a AS ({_CENT.format(0)}), b AS ({_CENT.format(2)}) SELECT round(avg(c), 6) AS cosine FROM (SELECT a.label, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS c FROM a JOIN b ON a.label = b.label AND a.d = b.d GROUP BY 1)")
def _(spark, d):
    """The map is the identity: the labels of most rows are the same in both runs."""
    lat, x = latents(spark, d).select("id", "latent"), labelings(spark, d)

    def centres(seed: int):
        per = lat.join(x.where(F.col("seed") == seed), "id").select("label", F.posexplode("latent").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("v"))
        return per.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda p: p["v"]).alias("vec"))

    names = agreement.align(x.where("seed = 0"), x.where("seed = 2"))[0]
    return agreement.centroid_cosine(centres(0), centres(2), names).select(r6("cosine").alias("cosine"))


@query("q15_projection_sample", "SELECT label::BIGINT AS label, least(count(*), 12) AS n, 8::INT AS dim FROM embeddings GROUP BY 1")
def _(spark, d):
    got = agreement.projection_sample(latents(spark, d), "label", 12, dim=8)
    at = next(c for c in got.columns if c not in ("id", "latent", "grp", "label") and got.schema[c].dataType.simpleString().startswith("array"))
    return got.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size(at)).alias("dim"))


@query("s15_published_versions", "SELECT l_suppkey AS region, CASE WHEN l_suppkey % 5 = 0 THEN count(*) ELSE count(*) FILTER (WHERE l_linenumber <= 3) END AS n FROM lineitem GROUP BY l_suppkey HAVING l_suppkey % 5 = 0 OR count(*) FILTER (WHERE l_linenumber <= 3) > 0")
def _(spark, d):
    """A version of all suppliers' short orders, then one that replaces every fifth supplier's."""
    path = _path(spark)
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("region"), "l_linenumber")
    versions.publish(lines.where("l_linenumber <= 3").groupBy("region").agg(F.count("*").alias("n")), path, "c1")
    fifth = lines.where("region % 5 = 0").groupBy("region").agg(F.count("*").alias("n"))
    versions.publish(fifth, path, "c1", replace=fifth.select("region"))
    return versions.read_version(spark, path).select("region", "n")
