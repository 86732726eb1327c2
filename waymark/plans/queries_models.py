"""Registered queries of regional models, rollouts, their stored tables and the jobs built on them.

The models of the queries with SQL see one number, the value of an event, and
predict the user's next one, so SQL's own regression gives the same fit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.common import materialize, shared_dir
from waymark.operators import graph, models, partition, routing, vectors
from waymark.plans import jobs
from waymark.plans.data import FRAMES, PROTOTYPES, ZSCORED, cache, frames, latents
from waymark.plans.registry import query
from waymark.sources import io

HORIZON = 3


def _values(spark: SparkSession, d: str) -> DataFrame:
    """(start, region, ep, last, emb, act_emb): two values of a user in order; ``last`` marks frames without a next one."""
    nxt = F.lead("v").over(Window.partitionBy("ep").orderBy("step"))
    rows = frames(spark, d).select("frame_id", "ep", "step", F.get("state", F.lit(0)).alias("v")).withColumn("n", nxt)
    still = F.array(F.array(F.lit(0.0)), F.array(F.lit(0.0)))
    return rows.select(F.col("frame_id").alias("start"), (F.col("ep") % 2).alias("region"), "ep", F.col("n").isNull().alias("last"), F.array(F.array("v"), F.array("n")).alias("emb"), still.alias("act_emb"))


def _fitted(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, models of the two regions)."""
    pairs = values.where(~F.col("last"))
    rows = models.training_rows(pairs)
    return rows, models.fit_regional(rows, pairs.select(F.col("start").alias("id"), "region"), 2, penalty=0.0)


_FIT = f"""{FRAMES}, v AS (SELECT frame_id AS start, ep, ep % 2 AS region, s0 AS z0, lead(s0, 1) OVER w AS z1, lead(s0, 2) OVER w AS z2, lead(s0, 3) OVER w AS z3 FROM frames WINDOW w AS (PARTITION BY ep ORDER BY step)),
fit AS (SELECT region AS model, regr_slope(z1, z0) AS s, regr_intercept(z1, z0) AS c, count(*) AS n FROM v WHERE z1 IS NOT NULL GROUP BY region),
p1 AS (SELECT v.*, model, s, c, s * z0 + c AS y1 FROM v, fit WHERE z3 IS NOT NULL), p2 AS (SELECT *, s * y1 + c AS y2 FROM p1), p3 AS (SELECT *, s * y2 + c AS y3 FROM p2),
roll AS (SELECT start, ep, region, model, unnest([1, 2, 3]) AS step, unnest([y1, y2, y3]) AS pred, unnest([(y1 - z1) ** 2, (y2 - z2) ** 2, (y3 - z3) ** 2]) AS loss FROM p3)"""


@query("m1_fit_regional", f"WITH {_FIT} SELECT model AS region, round(s, 6) AS slope, round(c, 6) AS intercept, n FROM fit")
def _(spark, d):
    coef = lambda i: F.round(F.get("coef", F.lit(i)), 6)
    return _fitted(materialize(_values(spark, d)))[1].select("region", coef(0).alias("slope"), coef(2).alias("intercept"), "n")


@query("m4_one_step_losses", f"WITH {_FIT} SELECT ep, model, count(*) AS n, round(avg((s * z0 + c - z1) ** 2), 4) AS loss FROM v, fit WHERE z1 IS NOT NULL GROUP BY ep, model")
def _(spark, d):
    values = materialize(_values(spark, d))
    rows, fitted = _fitted(values)
    losses = models.one_step_losses(rows, models.load_models(fitted, 0, 2)).join(values.select("start", "ep"), "start")
    return losses.groupBy("ep", "model").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 4).alias("loss"))


def _inputs(values: DataFrame) -> DataFrame:
    anchors = values.select("start", F.lead("start", HORIZON).over(Window.partitionBy("ep").orderBy("start")).alias("to")).where("to IS NOT NULL").select("start")
    return materialize(models.rollout_inputs(values, anchors, HORIZON).join(values.select("start", "ep", "region"), "start"))


@query("m5_rollout_losses", f"WITH {_FIT}, h AS (SELECT *, unnest([1, 3]) AS horizon FROM roll), g AS (SELECT start, model, horizon, arg_max(loss, step) AS terminal, avg(loss) AS mean_loss FROM h WHERE step <= horizon GROUP BY 1, 2, 3) SELECT model, horizon, count(*) AS n, round(avg(terminal), 4) AS terminal, round(avg(mean_loss), 4) AS mean_loss FROM g GROUP BY 1, 2")
def _(spark, d):
    values = materialize(_values(spark, d))
    losses = models.rollout_losses(_inputs(values), models.load_models(_fitted(values)[1], 0, 2), [1, HORIZON])
    return losses.groupBy("model", "horizon").agg(F.count("*").alias("n"), F.round(F.avg("terminal"), 4).alias("terminal"), F.round(F.avg("mean_loss"), 4).alias("mean_loss"))


@query("m6_switch_rollout", f"WITH {_FIT} SELECT ep, step, model, count(*) AS n, round(avg(loss), 4) AS loss, round(avg(pred), 4) AS pred FROM roll WHERE model = region GROUP BY 1, 2, 3")
def _(spark, d):
    values = materialize(_values(spark, d))
    inputs = _inputs(values)
    rolled = models.switch_rollout(inputs, models.load_models(_fitted(values)[1], 0, 2)).join(inputs.select("start", "ep"), "start")
    return rolled.groupBy("ep", "step", "model").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 4).alias("loss"), F.round(F.avg(F.get("pred", F.lit(0))), 4).alias("pred"))


@query("m8_rollout_deviation", f"WITH {_FIT}, b AS (SELECT x.step, x.loss AS la, y.loss AS lb, (x.pred - y.pred) ** 2 AS gap FROM roll x JOIN roll y ON x.start = y.start AND x.step = y.step WHERE x.model = 0 AND y.model = 1) SELECT step, round(avg(gap), 4) AS pairwise_mean, round(avg(la), 4) AS a_mean, round(stddev_pop(la), 4) AS a_sd, round(avg(lb), 4) AS b_mean, round(stddev_pop(lb), 4) AS b_sd FROM b GROUP BY step")
def _(spark, d):
    values = materialize(_values(spark, d))
    inputs, fitted = _inputs(values), models.load_models(_fitted(values)[1], 0, 2)
    a, b = (models.switch_rollout(inputs.withColumn("_m", F.lit(m)), fitted, "_m") for m in (0, 1))
    return models.rollout_deviation(a, b).select("step", *[F.round(c, 4).alias(c) for c in ("pairwise_mean", "a_mean", "a_sd", "b_mean", "b_sd")])


@query("m12_compare_heldout", f"WITH {_FIT}, g AS (SELECT start, model, arg_max(loss, step) AS t, avg(loss) AS m FROM roll GROUP BY 1, 2) SELECT 3 AS horizon, count(*) AS n, round(avg(b.t) - avg(a.t), 4) AS terminal_delta, round(avg(b.t) / avg(a.t), 6) AS terminal_ratio, round(avg(b.m) - avg(a.m), 4) AS mean_delta, round(avg(b.m) / avg(a.m), 6) AS mean_ratio FROM g a JOIN g b ON a.start = b.start WHERE a.model = 0 AND b.model = 1")
def _(spark, d):
    values = materialize(_values(spark, d))
    losses = materialize(models.rollout_losses(_inputs(values), models.load_models(_fitted(values)[1], 0, 2), [HORIZON]))
    out = models.compare_heldout(losses.where("model = 0"), losses.where("model = 1"))
    return out.select("horizon", "n", *[F.round(c, 4 if c.endswith("delta") else 6).alias(c) for c in ("terminal_delta", "terminal_ratio", "mean_delta", "mean_ratio")])


@query("m14_encode_frames", f"WITH {FRAMES} SELECT frame_id AS key, s0 + s1 AS a, s0 - s1 AS b FROM frames")
def _(spark, d):
    f = frames(spark, d)
    sums = lambda x: x @ [[1.0, 1.0], [1.0, -1.0]]
    vec = models.encode_frames(f.select("frame_id", F.col("frame_id").alias("key")), f, sums)
    return vec.select("key", F.get("vec", F.lit(0)).alias("a"), F.get("vec", F.lit(1)).alias("b"))


@query("j4_rollout_comparison", f"WITH {_FIT}, r AS (SELECT 'own' AS variant, step, loss FROM roll WHERE model = region UNION ALL SELECT 'other', step, loss FROM roll WHERE model <> region) SELECT variant, step, round(avg(loss), 4) AS mean, round(stddev_pop(loss), 4) AS sd, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, d):
    values = materialize(_values(spark, d))
    own = values.select("start", "region")
    fitted = models.load_models(_fitted(values)[1], 0, 2)
    anchors = _inputs(values).select("start")
    variants = {"own": (fitted, own), "other": (fitted, own.withColumn("region", 1 - F.col("region")))}
    out = jobs.run_rollouts(values, anchors, variants, HORIZON, "own")[0]
    return out.select("variant", "step", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


@query("j5_regional_models", f"WITH {_FIT} SELECT model AS region, n FROM fit")
def _(spark, d):
    values = materialize(_values(spark, d)).where(~F.col("last"))
    return jobs.run_regional(values, values.select(F.col("start").alias("id"), "region"), 2, penalty=0.0).select("region", "n")


@query("j6_preprocess_stability")
def _(spark, d):
    return jobs.run_preprocess_stability(latents(spark, d), list(vectors.VARIANTS), 3, list(range(20)), rel_tol=1e-5)[1]


@query("j7_restart_budget")
def _(spark, d):
    lat = latents(spark, d)
    z = materialize(vectors.zscore_l2(lat.select("id", "latent"), vectors.zscore_l2_fit(lat)).select("id", "z"))
    return jobs.run_restart_budget(z, 3, list(range(20)), 5, [1, 2, 3, 5])[1]


@query("g12_gate_spectra")
def _(spark, d):
    """The nine spectra that the gate judges."""
    return graph.evaluate_gate(latents(spark, d))[0]


@query("j9_gate")
def _(spark, d):
    return jobs.run_gate(cache(spark, d), F.floor(F.col("id") / 25))


@query("v5_model_for", f"WITH {_FIT} SELECT v.region, count(*) AS n, round(avg(s * z0 + c), 4) AS next_value FROM v JOIN fit ON v.region = fit.model GROUP BY v.region")
def _(spark, d):
    values = materialize(_values(spark, d))
    met = routing.model_for(values.select("start", "region", F.get(F.get("emb", F.lit(0)), F.lit(0)).alias("z")), _fitted(values)[1].select("region", "coef"))
    told = F.get("coef", F.lit(0)) * F.col("z") + F.get("coef", F.lit(2))
    return met.groupBy("region").agg(F.count("*").alias("n"), F.round(F.avg(told), 4).alias("next_value"))


@query("s4_write_cache", f"WITH {FRAMES} SELECT frame_id, s0 AS value FROM frames")
def _(spark, d):
    path = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    io.write_cache(frames(spark, d), path)
    return spark.read.parquet(path).select("frame_id", F.get("state", F.lit(0)).alias("value"))


@query("s7_artifact", f"WITH {ZSCORED}, {PROTOTYPES} SELECT id, region FROM routed")
def _(spark, d):
    """A partition written, read back, and replayed on all latents."""
    path = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    lat = latents(spark, d)
    part = partition.fit_random_voronoi(lat, 3, 7)
    io.write_artifact(path, part.prototypes, part.stats, part.meta)
    prototypes, params, _ = io.read_artifact(spark, path)
    return routing.route(lat, prototypes, params).select("id", "region")
