"""Registered queries of models, risk, agreement, results and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import agreement, audit, models, results, risk
from waymark.plans.data import LABELINGS, LATENTS, LOSSES, RUNS, labelings, latents, losses, runs, table
from waymark.plans.registry import query


def r6(c):
    return F.round(c, 6)


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


MSE = risk.MSE
_MSE = ", ".join(f"round(avg({c}), 6) AS {c}" for c in MSE)


@query("k1_expert_losses", f"WITH {LOSSES} SELECT episode, start, region, round(global_mse, 6) AS global_mse, round(correct_mse, 6) AS correct_mse, round(wrong_mean_mse, 6) AS wrong_mean_mse, round(wrong_best_mse, 6) AS wrong_best_mse FROM samples")
def _(spark, d):
    return rounded(risk.expert_losses(losses(spark, d), 3).drop("seed"), *MSE)


_REGION = f"""{LOSSES}, rm AS (SELECT region, count(DISTINCT episode) AS num_episodes, count(*) AS num_anchors, avg(global_mse) AS global_mse, avg(correct_mse) AS correct_mse, avg(wrong_mean_mse) AS wrong_mean_mse, avg(wrong_best_mse) AS wrong_best_mse FROM samples GROUP BY region),
rr AS (SELECT k.region, coalesce(num_episodes, 0) AS num_episodes, coalesce(num_anchors, 0) AS num_anchors, global_mse, correct_mse, wrong_mean_mse, wrong_best_mse, coalesce(num_anchors, 0) / sum(num_anchors) OVER () AS region_weight FROM (SELECT unnest(range(0, 4)) AS region) k LEFT JOIN rm ON rm.region = k.region)"""


@query("k2_region_metrics", f"WITH {_REGION} SELECT region, num_episodes, num_anchors, round(global_mse, 6) AS global_mse, round(correct_mse, 6) AS correct_mse, round(wrong_mean_mse, 6) AS wrong_mean_mse, round(wrong_best_mse, 6) AS wrong_best_mse, round(region_weight, 6) AS region_weight, round(global_mse - correct_mse, 6) AS global_minus_correct, round((global_mse - correct_mse) / global_mse, 6) AS relative_gain, round(wrong_mean_mse - correct_mse, 6) AS wrong_penalty, num_episodes < 5 OR num_anchors < 1000 AS low_support FROM rr")
def _(spark, d):
    return rounded(risk.region_metrics(risk.expert_losses(losses(spark, d), 3), 4), *MSE, "region_weight", "global_minus_correct", "relative_gain", "wrong_penalty")


@query("k3_weighted_summary", f"WITH {_REGION}, s AS (SELECT sum(region_weight * global_mse) / sum(region_weight) AS g, sum(region_weight * correct_mse) / sum(region_weight) AS c, sum(region_weight * wrong_mean_mse) / sum(region_weight) AS w, sum(region_weight * wrong_best_mse) / sum(region_weight) AS b, (SELECT count(*) FROM rr WHERE region_weight <= 0) AS e FROM rr WHERE region_weight > 0) SELECT round(g, 6) AS global_mse, round(c, 6) AS correct_mse, round(w, 6) AS wrong_mean_mse, round(b, 6) AS wrong_best_mse, e AS num_empty_regions, round(g - c, 6) AS global_minus_correct, round((g - c) / g, 6) AS relative_gain FROM s")
def _(spark, d):
    return rounded(risk.weighted_summary(risk.region_metrics(risk.expert_losses(losses(spark, d), 3), 4)), *MSE, "global_minus_correct", "relative_gain")


@query("k4_episode_metrics", f"WITH {LOSSES} SELECT seed, episode, count(*) AS n, {_MSE} FROM samples GROUP BY 1, 2")
def _(spark, d):
    return rounded(risk.episode_metrics(risk.expert_losses(losses(spark, d), 3)), *MSE)


_U = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(
    "k5_paired_bootstrap",
    f"""WITH {LOSSES}, ep AS (SELECT episode, avg(global_mse) - avg(correct_mse) AS d FROM samples GROUP BY 1), nth AS (SELECT row_number() OVER (ORDER BY episode) - 1 AS slot, d FROM ep), n AS (SELECT count(*) AS n FROM nth),
dr AS (SELECT rep, {_U.format("'9:' || rep || ':' || slot")} % n AS at FROM (SELECT unnest(range(0, 50000)) AS rep), nth, n), m AS (SELECT rep, avg(d) AS m FROM dr JOIN nth ON nth.slot = dr.at GROUP BY rep)
SELECT (SELECT round(avg(d), 6) FROM nth) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
)
def _(spark, d):
    ep = risk.expert_losses(losses(spark, d), 3).groupBy("episode").agg(F.avg("global_mse").alias("global_mse"), F.avg("correct_mse").alias("correct_mse"))
    return rounded(risk.paired_bootstrap(ep, 50_000, 9, key="episode"), "estimate", "low", "high")


@query(
    "k6_nested_bootstrap",
    f"""WITH {LOSSES}, c AS (SELECT seed, episode, sum(global_mse - correct_mse) AS s, count(*) AS c FROM samples GROUP BY 1, 2), sd AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS pos FROM (SELECT DISTINCT seed FROM c)), ed AS (SELECT episode, row_number() OVER (ORDER BY episode) - 1 AS pos FROM (SELECT DISTINCT episode FROM c)),
rp AS (SELECT unnest(range(0, 50000)) AS rep), ts AS (SELECT rep, sd.seed, ks FROM (SELECT rep, {_U.format("'9:' || rep || ':' || pos")} % (SELECT count(*) FROM sd) AS a, count(*) AS ks FROM rp, sd GROUP BY 1, 2) JOIN sd ON sd.pos = a),
te AS (SELECT rep, ed.episode, ke FROM (SELECT rep, {_U.format("'10:' || rep || ':' || pos")} % (SELECT count(*) FROM ed) AS a, count(*) AS ke FROM rp, ed GROUP BY 1, 2) JOIN ed ON ed.pos = a),
pr AS (SELECT rep, seed, sum(ke * s) / sum(ke * c) AS m FROM te JOIN c ON c.episode = te.episode GROUP BY 1, 2), ms AS (SELECT pr.rep, sum(ks * m) / sum(ks) AS m FROM pr JOIN ts ON ts.rep = pr.rep AND ts.seed = pr.seed GROUP BY 1)
SELECT (SELECT round(avg(m), 6) FROM (SELECT sum(s) / sum(c) AS m FROM c GROUP BY seed)) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM ms""",
)
def _(spark, d):
    return rounded(risk.nested_bootstrap(risk.expert_losses(losses(spark, d), 3), 50_000, 9), "estimate", "low", "high")


@query("k7_success_blocks", f"WITH {RUNS}, p AS (SELECT method, train_seed, eval_seed, avg(success_rate) AS r FROM runs GROUP BY 1, 2, 3) SELECT a.train_seed, a.eval_seed, round(a.r, 6) AS a, round(b.r, 6) AS b FROM p a JOIN p b ON a.train_seed = b.train_seed AND a.eval_seed = b.eval_seed WHERE a.method = 'A' AND b.method = 'R'")
def _(spark, d):
    return rounded(risk.success_blocks(runs(spark, d), "A", "R").drop("i"), "a", "b")


@query(
    "k7_success_bootstrap",
    f"""WITH {RUNS}, p AS (SELECT method, train_seed, eval_seed, avg(success_rate) AS r FROM runs GROUP BY 1, 2, 3), b AS (SELECT a.train_seed, a.eval_seed, a.r - b.r AS d FROM p a JOIN p b ON a.train_seed = b.train_seed AND a.eval_seed = b.eval_seed WHERE a.method = 'A' AND b.method = 'R'),
nth AS (SELECT row_number() OVER (ORDER BY train_seed, eval_seed) - 1 AS slot, d FROM b), n AS (SELECT count(*) AS n FROM nth),
dr AS (SELECT rep, {_U.format("'3:' || rep || ':' || slot")} % n AS at FROM (SELECT unnest(range(0, 50000)) AS rep), nth, n), m AS (SELECT rep, avg(d) AS m FROM dr JOIN nth ON nth.slot = dr.at GROUP BY rep)
SELECT (SELECT round(avg(d), 6) FROM nth) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
)
def _(spark, d):
    return rounded(risk.success_bootstrap(runs(spark, d), "A", "R", 50_000, 3), "estimate", "low", "high")


_STEP = "st AS (SELECT l_orderkey AS start, l_linenumber AS step, l_returnflag AS variant, avg(l_tax + l_discount) AS loss, max(l_suppkey % 3) AS region FROM lineitem GROUP BY 1, 2, 3)"


def _steps(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("start"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("variant")).agg(F.avg(F.col("l_tax") + F.col("l_discount")).alias("loss"), F.max(F.col("l_suppkey") % 3).alias("region"))


@query("m9_rollout_summary", f"WITH {_STEP} SELECT step, region, round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS sd, count(*) AS n FROM st GROUP BY GROUPING SETS ((step, region), (step))")
def _(spark, d):
    return rounded(models.rollout_summary(_steps(spark, d)), "mean", "sd")


@query("m10_delta_vs", f"WITH {_STEP}, x AS (SELECT a.variant, a.step, a.loss - b.loss AS dl FROM st a JOIN st b ON a.start = b.start AND a.step = b.step AND b.variant = 'N' WHERE a.variant <> 'N') SELECT variant, step, round(avg(dl), 6) AS mean_delta, round(stddev_pop(dl), 6) AS sd_delta, round(avg(CASE WHEN dl < 0 THEN 1.0 ELSE 0.0 END), 6) AS improved, round(avg(CASE WHEN dl > 0 THEN 1.0 ELSE 0.0 END), 6) AS worse FROM x GROUP BY 1, 2")
def _(spark, d):
    return rounded(models.delta_vs(_steps(spark, d), "N"), "mean_delta", "sd_delta", "improved", "worse")


@query("m15_select_best", "WITH h AS (SELECT l_suppkey % 3 AS region, l_partkey % 25 AS iteration, round(avg(l_tax), 4) AS eval_loss FROM lineitem GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY eval_loss, iteration) AS n FROM h) SELECT region, iteration, eval_loss FROM o WHERE n = 1")
def _(spark, d):
    h = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("region"), (F.col("l_partkey") % 25).alias("iteration")).agg(F.round(F.avg("l_tax"), 4).alias("eval_loss"))
    return models.select_best(h)


_YP = "yp AS (SELECT vec_id AS id, label % 4 AS y, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 4 ELSE label % 4 END AS p FROM embeddings)"
_PC = f"{_YP}, lb AS (SELECT DISTINCT y AS label FROM yp UNION SELECT DISTINCT p FROM yp), c AS (SELECT label, count(*) FILTER (WHERE y = label) AS support, count(*) FILTER (WHERE p = label) AS told, count(*) FILTER (WHERE y = label AND p = label) AS tp FROM lb, yp GROUP BY label), m AS (SELECT label, support, tp, CASE WHEN told > 0 THEN tp / told ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM c), f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m)"


def _yp(spark, d):
    return table(spark, d, "embeddings").select((F.col("label") % 4).alias("y"), F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label") % 4).alias("p"))


@query("q1_per_class", f"WITH {_PC} SELECT label, support, tp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _(spark, d):
    return rounded(agreement.per_class(_yp(spark, d)), "precision", "recall", "f1")


@query("q1_classification", f"WITH {_PC} SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN rc END), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def _(spark, d):
    return rounded(agreement.classification_metrics(_yp(spark, d)), "accuracy", "balanced_accuracy", "macro_f1")


@query("q2_alignment", f"WITH {LABELINGS}, p AS (SELECT unnest([[0,1,2,3],[0,1,3,2],[0,2,1,3],[0,2,3,1],[0,3,1,2],[0,3,2,1],[1,0,2,3],[1,0,3,2],[1,2,0,3],[1,2,3,0],[1,3,0,2],[1,3,2,0],[2,0,1,3],[2,0,3,1],[2,1,0,3],[2,1,3,0],[2,3,0,1],[2,3,1,0],[3,0,1,2],[3,0,2,1],[3,1,0,2],[3,1,2,0],[3,2,0,1],[3,2,1,0]]) AS p), j AS (SELECT a.label AS la, b.label AS lb FROM labelings a JOIN labelings b ON a.id = b.id WHERE a.seed = 0 AND b.seed = 2), s AS (SELECT p, avg(CASE WHEN p[(lb + 1)::INT] = la THEN 1.0 ELSE 0.0 END) AS share FROM j, p GROUP BY p) SELECT round(max(share), 6) AS agreement FROM s")
def _(spark, d):
    x = labelings(spark, d)
    _map, share = agreement.align(x.where("seed = 0"), x.where("seed = 2"))
    return spark.createDataFrame([(round(share, 6),)], "agreement double")


_PAIR = f"""{LABELINGS}, c AS (SELECT a.seed AS seed_a, b.seed AS seed_b, a.label AS la, b.label AS lb, count(*)::DOUBLE AS n FROM labelings a JOIN labelings b ON a.id = b.id AND a.seed < b.seed GROUP BY 1, 2, 3, 4),
ra AS (SELECT seed_a, seed_b, la, sum(n) AS r FROM c GROUP BY 1, 2, 3), rb AS (SELECT seed_a, seed_b, lb, sum(n) AS r FROM c GROUP BY 1, 2, 3), t AS (SELECT seed_a, seed_b, sum(n) AS t, sum(n * (n - 1) / 2) AS same FROM c GROUP BY 1, 2),
sa AS (SELECT ra.seed_a, ra.seed_b, sum(r * (r - 1) / 2) AS s, sum(-r / t * ln(r / t)) AS h FROM ra JOIN t ON t.seed_a = ra.seed_a AND t.seed_b = ra.seed_b GROUP BY 1, 2), sb AS (SELECT rb.seed_a, rb.seed_b, sum(r * (r - 1) / 2) AS s, sum(-r / t * ln(r / t)) AS h FROM rb JOIN t ON t.seed_a = rb.seed_a AND t.seed_b = rb.seed_b GROUP BY 1, 2),
mi AS (SELECT c.seed_a, c.seed_b, sum(c.n / t * ln(c.n * t / (ra.r * rb.r))) AS mi FROM c JOIN t ON t.seed_a = c.seed_a AND t.seed_b = c.seed_b JOIN ra ON ra.seed_a = c.seed_a AND ra.seed_b = c.seed_b AND ra.la = c.la JOIN rb ON rb.seed_a = c.seed_a AND rb.seed_b = c.seed_b AND rb.lb = c.lb GROUP BY 1, 2),
ps AS (SELECT t.seed_a, t.seed_b, t.t::BIGINT AS n, (same - sa.s * sb.s / (t * (t - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (t * (t - 1) / 2)) AS ari, 2 * mi / (sa.h + sb.h) AS nmi FROM t JOIN sa ON sa.seed_a = t.seed_a AND sa.seed_b = t.seed_b JOIN sb ON sb.seed_a = t.seed_a AND sb.seed_b = t.seed_b JOIN mi ON mi.seed_a = t.seed_a AND mi.seed_b = t.seed_b)"""


@query("q3_pairwise_stability", f"WITH {_PAIR} SELECT seed_a, seed_b, n, round(ari, 6) AS ari, round(nmi, 6) AS nmi FROM ps")
def _(spark, d):
    return rounded(agreement.pairwise_stability(labelings(spark, d)), "ari", "nmi")


@query("q5_medoid_run", f"WITH {_PAIR} SELECT seed, round(avg(ari), 6) AS mean_ari FROM (SELECT seed_a AS seed, ari FROM ps UNION ALL SELECT seed_b, ari FROM ps) GROUP BY seed ORDER BY avg(ari) DESC, seed LIMIT 1")
def _(spark, d):
    return rounded(agreement.medoid_run(agreement.pairwise_stability(labelings(spark, d))), "mean_ari")


@query("q5_consensus", f"WITH {LABELINGS}, v AS (SELECT id, max(n) / sum(n) AS q FROM (SELECT id, label, count(*) AS n FROM labelings GROUP BY 1, 2) GROUP BY id) SELECT round(avg(q), 6) AS mean_q, round(avg(CASE WHEN q = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_full, round(avg(CASE WHEN q >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS share_high, round(avg(CASE WHEN q < 0.7 THEN 1.0 ELSE 0.0 END), 6) AS share_low FROM v")
def _(spark, d):
    c = agreement.consensus(labelings(spark, d))
    return rounded(c, *c.columns)


@query("q6_pair_summary", f"WITH {_PAIR} SELECT 'ari' AS metric, round(avg(ari), 6) AS mean, round(stddev_pop(ari), 6) AS sd, round(median(ari), 6) AS median, round(min(ari), 6) AS least, round(max(ari), 6) AS most FROM ps")
def _(spark, d):
    return rounded(agreement.summarize_pairs(agreement.pairwise_stability(labelings(spark, d)), ["ari"]), "mean", "sd", "median", "least", "most")


@query("q7_cluster_fractions", "WITH n AS (SELECT k, count(e.vec_id) AS n FROM (SELECT unnest(range(0, 12)) AS k) LEFT JOIN embeddings e ON e.label = k GROUP BY k) SELECT (row_number() OVER (ORDER BY n, k) - 1)::INT AS pos, round(n / sum(n) OVER (), 6) AS fraction FROM n")
def _(spark, d):
    f = agreement.cluster_fractions(table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label")), 12)
    return f.select(F.posexplode("fractions").alias("pos", "fraction")).withColumn("fraction", r6("fraction"))


@query("q8_budget_summary", "WITH r AS (SELECT l_suppkey % 5 AS outer_seed, l_partkey % 20 AS restart, avg(l_discount) AS objective FROM lineitem GROUP BY 1, 2), b AS (SELECT budget, outer_seed, max(objective) AS best FROM r, (SELECT unnest([1, 5, 10, 20]) AS budget) WHERE restart < budget GROUP BY 1, 2) SELECT budget, round(avg(top - best), 6) AS mean_gap, round(max(top - best), 6) AS max_gap FROM b, (SELECT max(objective) AS top FROM r) GROUP BY budget")
def _(spark, d):
    r = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("outer_seed"), (F.col("l_partkey") % 20).alias("restart")).agg(F.avg("l_discount").alias("objective"))
    return rounded(agreement.budget_summary(r, [1, 5, 10, 20]), "mean_gap", "max_gap")


_SPLITS = "sp AS (SELECT l_suppkey % 4 AS seed, CASE WHEN l_linenumber % 3 = 0 THEN 'iid' ELSE 's' || l_linenumber END AS split, avg(l_tax) AS drift FROM lineitem GROUP BY 1, 2)"


def _splits(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.groupBy((F.col("l_suppkey") % 4).alias("seed"), F.when(F.col("l_linenumber") % 3 == 0, "iid").otherwise(F.concat(F.lit("s"), F.col("l_linenumber"))).alias("split")).agg(F.avg("l_tax").alias("drift"))


@query("q11_excess", f"WITH {_SPLITS}, b AS (SELECT avg(drift) AS m, stddev_samp(drift) AS s FROM sp WHERE split = 'iid') SELECT seed, split, round(drift - m, 6) AS excess, round((drift - m) / s, 4) AS z FROM sp, b")
def _(spark, d):
    s = _splits(spark, d)
    return agreement.add_excess(s, s.where("split = 'iid'"), "drift").select("seed", "split", r6("excess").alias("excess"), F.round("z", 4).alias("z"))


@query("q12_iid_ratios", f"WITH {_SPLITS} SELECT a.seed, a.split, round(a.drift / b.drift, 6) AS ratio FROM sp a LEFT JOIN sp b ON a.seed = b.seed AND b.split = 'iid'")
def _(spark, d):
    return agreement.add_iid_ratios(_splits(spark, d), "drift").select("seed", "split", r6("ratio").alias("ratio"))


@query("q14_probe_summary", f"WITH {RUNS}, p AS (SELECT method AS model, eval_seed AS seed, avg(success_rate) AS f FROM runs GROUP BY 1, 2) SELECT a.model, round(avg(a.f), 6) AS mean, round(stddev_pop(a.f), 6) AS sd, round(avg(a.f - b.f), 6) AS mean_delta, count(*) FILTER (WHERE a.f - b.f > 0) AS n_positive FROM p a LEFT JOIN p b ON a.seed = b.seed AND b.model = 'N' GROUP BY a.model")
def _(spark, d):
    p = runs(spark, d).groupBy(F.col("method").alias("model"), F.col("eval_seed").alias("seed")).agg(F.avg("success_rate").alias("macro_f1"))
    return rounded(agreement.probe_summary(p, base="N"), "mean", "sd", "mean_delta")


@query("a1_matrix_summary", f"WITH {RUNS}, p AS (SELECT method, train_seed, avg(success_rate) AS m FROM runs GROUP BY 1, 2), t AS (SELECT method, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS sd_train, count(*) AS n_train FROM p GROUP BY 1), a AS (SELECT method, coalesce(stddev_samp(success_rate), 0) AS sd_all, count(*) AS n FROM runs GROUP BY 1) SELECT t.method, round(mean, 6) AS mean, round(sd_train, 6) AS sd_train, n_train, round(sd_all, 6) AS sd_all, n FROM t JOIN a ON t.method = a.method")
def _(spark, d):
    return rounded(results.matrix_summary(runs(spark, d)), "mean", "sd_train", "sd_all")


@query("a2_add_arm", f"WITH {RUNS} SELECT method, count(DISTINCT train_seed) AS n_train, count(*) AS n FROM runs GROUP BY method")
def _(spark, d):
    r = runs(spark, d)
    return results.add_arm(results.matrix_summary(r.where("method <> 'R'")), r.where("method = 'A'"), r.where("method = 'R'")).select("method", "n_train", "n")


@query("a3_main_table", f"WITH {RUNS}, p AS (SELECT method, train_seed, avg(success_rate) AS m FROM runs GROUP BY 1, 2) SELECT method, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS n_seeds FROM p GROUP BY 1")
def _(spark, d):
    return rounded(results.main_table(runs(spark, d)), "mean", "sd")


@query("a4_pairing_audit", f"WITH {RUNS} SELECT eval_seed, 1::BIGINT AS n_start_lists, true AS paired FROM runs GROUP BY eval_seed")
def _(spark, d):
    return results.pairing_audit(runs(spark, d))


@query("a5_check_existing", f"WITH {RUNS}, p AS (SELECT method, eval_seed, round(avg(success_rate), 6) AS m FROM runs GROUP BY 1, 2) SELECT method, eval_seed, m AS new_value, CASE WHEN eval_seed = 4 THEN NULL ELSE m + 1 END AS old_value FROM p WHERE eval_seed = 4 OR method = 'A'")
def _(spark, d):
    p = runs(spark, d).groupBy("method", "eval_seed").agg(r6(F.avg("success_rate")).alias("m"))
    old = p.where("eval_seed <> 4").withColumn("m", F.when(F.col("method") == "A", F.col("m") + 1).otherwise(F.col("m")))
    return results.check_existing(p, old, ["method", "eval_seed"], "m")


@query("a6_by_mode", f"WITH {RUNS} SELECT method, count(*) AS n, round(avg(success_rate), 6) AS mean, round(coalesce(stddev_samp(success_rate), 0), 6) AS sd, round(min(success_rate), 6) AS least FROM runs GROUP BY 1")
def _(spark, d):
    return rounded(results.by_mode(runs(spark, d)), "mean", "sd").withColumn("least", r6(F.get("rates", F.lit(0)))).drop("rates")


@query("a7_partition_matrix", f"WITH {RUNS} SELECT partition_seed, eval_seed, round(avg(success_rate), 6) AS mean, count(*) AS n FROM runs GROUP BY CUBE (partition_seed, eval_seed)")
def _(spark, d):
    return rounded(results.partition_matrix(runs(spark, d)), "mean")


@query("a7_paired_diff", f"WITH {RUNS} SELECT eval_seed, round(avg(success_rate) FILTER (WHERE method = 'A'), 6) AS a, round(avg(success_rate) FILTER (WHERE method = 'R'), 6) AS b, round(avg(success_rate) FILTER (WHERE method = 'A') - avg(success_rate) FILTER (WHERE method = 'R'), 6) AS diff FROM runs GROUP BY 1")
def _(spark, d):
    r = runs(spark, d)
    return rounded(results.paired_diff(r.where("method = 'A'"), r.where("method = 'R'")), "a", "b", "diff")


@query("a8_seed_sweep", f"WITH {RUNS} SELECT method, eval_seed, count(*) AS n, round(avg(success_rate), 6) AS success_rate_mean, round(coalesce(stddev_samp(success_rate), 0), 6) AS success_rate_sd FROM runs GROUP BY 1, 2")
def _(spark, d):
    return rounded(results.summarize(runs(spark, d), ["method", "eval_seed"], ["success_rate"]), "success_rate_mean", "success_rate_sd")


@query("a9_joint_summary", "SELECT o.ord, o.split, round(p.v, 6) AS predictor, round(e.v, 6) AS encoder FROM (SELECT unnest([0, 1, 2]) AS ord, unnest(['A', 'N', 'X']) AS split) o LEFT JOIN (SELECT l_returnflag AS split, avg(l_tax) AS v FROM lineitem GROUP BY 1) p ON p.split = o.split LEFT JOIN (SELECT l_linestatus AS split, avg(l_tax) AS v FROM lineitem GROUP BY 1) e ON e.split = o.split")
def _(spark, d):
    per = lambda c: table(spark, d, "lineitem").groupBy(F.col(c).alias("split")).agg(F.avg("l_tax").alias("value"))
    return rounded(results.joint_summary(["A", "N", "X"], per("l_returnflag"), per("l_linestatus")), "predictor", "encoder")


@query("a10_latency_summary", "WITH t AS (SELECT event_type AS variant, user_id AS run, event_id AS solve, value AS seconds, 4 AS num_envs FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY variant, run ORDER BY solve) AS n FROM t), p AS (SELECT variant, avg(1000 * seconds / num_envs) AS m, coalesce(stddev_samp(1000 * seconds / num_envs), 0) AS s, count(*) AS n FROM f WHERE n = 1 GROUP BY 1), b AS (SELECT m AS base FROM p ORDER BY variant LIMIT 1) SELECT variant, round(m, 4) AS ms_mean, round(s, 4) AS ms_sd, n, round(100 * (m / base - 1), 4) AS overhead_pct FROM p, b")
def _(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("variant"), F.col("user_id").alias("run"), F.col("event_id").alias("solve"), F.col("value").alias("seconds"), F.lit(4).alias("num_envs"))
    first = t.agg(F.min("variant")).first()[0]
    return results.latency_summary(t, first).withColumns({c: F.round(c, 4) for c in ("ms_mean", "ms_sd", "overhead_pct")})


@query("d5_acceptance", f"WITH {RUNS}, f AS (SELECT method AS name, avg(success_rate) < 100 AND method <> 'R' AS ok FROM runs GROUP BY 1) SELECT bool_and(ok) AS accepted, string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT ok) AS failed, bool_and(ok) AS eligible FROM f")
def _(spark, d):
    f = runs(spark, d).groupBy(F.col("method").alias("name")).agg((F.avg("success_rate") < 100).alias("ok")).withColumn("ok", F.col("ok") & (F.col("name") != "R"))
    return audit.acceptance(f).withColumn("failed", F.array_join("failed", ","))


@query("d6_finite_scan", "SELECT 'value' AS \"column\", count(*) FILTER (WHERE isinf(value)) AS n_inf, count(*) FILTER (WHERE isnan(value)) AS n_nan, count(*) FILTER (WHERE value IS NULL) AS n_null FROM events")
def _(spark, d):
    return audit.finite_scan(table(spark, d, "events"), ["value"])


@query("d6_verify_run", f"WITH {LOSSES} SELECT true AS finite, count(DISTINCT seed) >= 3 AS enough_seeds, true AS all_horizons, true AS one_step_agrees FROM samples")
def _(spark, d):
    s = risk.expert_losses(losses(spark, d), 3).select("seed", F.col("global_mse").alias("terminal"), F.explode(F.array(F.lit(1), F.lit(5))).alias("horizon"))
    return audit.verify_run(s.withColumn("mean_loss", F.when(F.col("horizon") == 1, F.col("terminal")).otherwise(F.col("terminal") / 2)), [1, 5])


@query("d7_ordered_hash", "SELECT sha256(string_agg(n_name, ',' ORDER BY n_nationkey)) AS sha256 FROM nation")
def _(spark, d):
    return audit.ordered_hash(table(spark, d, "nation"), "n_name", "n_nationkey")


@query("d8_check_manifest", "SELECT n_name AS key, n_nationkey::VARCHAR AS got, (n_nationkey + 1)::VARCHAR AS want FROM nation WHERE n_nationkey % 5 = 0")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("k"))
    return audit.check_manifest(n.select("key", F.col("k").cast("string").alias("value")), n.select("key", F.when(F.col("k") % 5 == 0, F.col("k") + 1).otherwise(F.col("k")).cast("string").alias("value")))


_GATE = "gt AS (SELECT l_suppkey AS task, avg(l_discount) AS e, avg(l_tax) / 4 AS t, 0.02 AS t_bg, count(DISTINCT l_linenumber)::BIGINT AS n_graphs FROM lineitem GROUP BY 1), gs AS (SELECT *, e - t AS r, 1 - t / e AS s FROM gt)"


@query("d9_verify_gate", f"WITH {_GATE} SELECT task, s >= 0.5 AND r > t_bg AND r > 0 AS choice_implied, true AS numbers_agree, n_graphs = 7 AS all_graphs FROM gs")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("task")).agg(F.avg("l_discount").alias("e"), (F.avg("l_tax") / 4).alias("t"), F.countDistinct("l_linenumber").alias("n_graphs"))
    g = g.withColumns({"t_bg": F.lit(0.02), "r": F.col("e") - F.col("t"), "s": 1 - F.col("t") / F.col("e"), "choice": F.lit("spectral"), "want_graphs": F.lit(7)})
    return audit.verify_gate(g)


@query("d12_gate_summary", "WITH l AS (SELECT l_suppkey % 6 AS task, l_partkey % 9 AS region, count(*) AS n FROM lineitem WHERE l_partkey % 9 < 7 GROUP BY 1, 2), t AS (SELECT task, sum(n) AS rows, count(*) AS used FROM l GROUP BY 1) SELECT l.task, 'global' AS choice, count(*) FILTER (WHERE n < greatest(1.0, 0.001 * rows)) AS n_tiny, 9 - max(used) AS n_empty, max(rows)::BIGINT AS rows FROM l JOIN t ON l.task = t.task GROUP BY l.task")
def _(spark, d):
    l = table(spark, d, "lineitem").where("l_partkey % 9 < 7").select((F.col("l_suppkey") % 6).alias("task"), (F.col("l_partkey") % 9).alias("region"))  # noqa: E741
    return audit.gate_summary(l.select("task").distinct().withColumn("choice", F.lit("global")), l, 9)


@query("s14_report", """SELECT '{"n_episodes":' || count(DISTINCT user_id) || ',"n_rows":' || count(*) || '}' AS report FROM events""")
def _(spark, d):
    from waymark.sources.io import emit_report

    n = table(spark, d, "events").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_episodes")).first().asDict()
    return emit_report(spark, n)


#: Alignment of columns 1 and 2 to columns 3 and 4 of each split, in closed form for two columns; ``ref`` is the reference.
_DRIFT = """m AS (SELECT split, count(*) AS n, var_pop(x1) AS a11, covar_pop(x1, x2) AS a12, var_pop(x2) AS a22, covar_pop(x1, y1) AS c11, covar_pop(x1, y2) AS c12, covar_pop(x2, y1) AS c21, covar_pop(x2, y2) AS c22, var_pop(y1) AS s1, var_pop(y2) AS s2 FROM w GROUP BY split),
e AS (SELECT m.*, k1, k2, c11 / k1 AS m11, c12 / k2 AS m12, c21 / k1 AS m21, c22 / k2 AS m22 FROM m, (SELECT sqrt(greatest(s1, 1e-12)) AS k1, sqrt(greatest(s2, 1e-12)) AS k2 FROM m WHERE split = 'ref')),
s AS (SELECT *, sign(m11 * m22 - m12 * m21) AS g, sqrt(m11 ** 2 + m12 ** 2 + m21 ** 2 + m22 ** 2 + 2 * abs(m11 * m22 - m12 * m21)) AS s FROM e),
p AS (SELECT *, (m11 + g * m22) / s AS p11, (m12 - g * m21) / s AS p12, (m21 - g * m12) / s AS p21, (m22 + g * m11) / s AS p22, a11 + a22 + s1 / k1 ** 2 + s2 / k2 ** 2 - 2 * s AS residual,
  ((a22 * c11 ** 2 - 2 * a12 * c11 * c21 + a11 * c21 ** 2) + (a22 * c12 ** 2 - 2 * a12 * c12 * c22 + a11 * c22 ** 2)) / (a11 * a22 - a12 ** 2) / (s1 + s2) AS r2 FROM s)
SELECT p.split, p.n, round(sqrt((p.p11 - r.p11) ** 2 + (p.p12 - r.p12) ** 2 + (p.p21 - r.p21) ** 2 + (p.p22 - r.p22) ** 2), 5) AS drift, round(p.residual, 6) AS residual, round(p.residual / r.residual, 6) AS residual_ratio, round(p.r2, 6) AS r2 FROM p, (SELECT * FROM p WHERE split = 'ref') r"""
_PAIRS = "lat2 AS (SELECT id, label, latent[1] AS x1, latent[2] AS x2, latent[3] AS y1, latent[4] AS y2 FROM lat)"


def _pairs(spark, d):
    return latents(spark, d).select("id", "label", F.slice("latent", 1, 2).alias("latent"), F.slice("latent", 3, 2).alias("state"), (F.col("label") < 5).alias("ref"))


def _drift(out):
    return out.select("split", "n", F.round("drift", 5).alias("drift"), *[F.round(c, 6).alias(c) for c in ("residual", "residual_ratio", "r2")])


@query("q9_drift", f"WITH {LATENTS}, {_PAIRS}, w AS (SELECT 'ref' AS split, * FROM lat2 WHERE label < 5 UNION ALL SELECT 'even', * FROM lat2 WHERE label % 2 = 0 UNION ALL SELECT 'high', * FROM lat2 WHERE label >= 5), {_DRIFT}")
def _(spark, d):
    rows = _pairs(spark, d).withColumns({"even": F.col("label") % 2 == 0, "high": F.col("label") >= 5})
    return _drift(agreement.drift_metrics(rows, ["even", "high"], "ref"))


@query(
    "q10_iid_drift",
    f"""WITH {LATENTS}, {_PAIRS}, t AS (SELECT unnest(range(0, 5)) AS t), w AS (SELECT 'ref' AS split, * FROM lat2 WHERE label < 5
UNION ALL SELECT 'iid_' || t, lat2.* FROM lat2, t WHERE label >= 5 AND ('0x' || substr(md5((100 + t) || ':' || id), 1, 8))::UBIGINT / 4294967296.0 < 0.5), dr AS (WITH {_DRIFT}) SELECT * FROM dr WHERE split <> 'ref'""",
)
def _(spark, d):
    return _drift(agreement.iid_drift(_pairs(spark, d), "ref", 5, 0.5, 100))
