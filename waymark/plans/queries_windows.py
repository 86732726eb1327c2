"""Registered queries of sources, windows, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.common import seeded
from waymark.operators import audit, sampling, windows
from waymark.plans.data import FRAMES, LATENTS, SLOTS, cache, frames, latents, table
from waymark.plans.registry import query
from waymark.sources import io


def r6(c):
    return F.round(c, 6)


@query("s1_read_frames", "SELECT event_id, user_id, value FROM events WHERE value >= (SELECT avg(value) FROM events)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    ids = e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("m")))).where("value >= m").select("event_id")
    return io.read_frames(spark, f"{d}/events.parquet", ["event_id", "user_id", "value", "pixels"], ids, "event_id")


@query("s3_cache_contract", f"WITH {SLOTS}, c AS (SELECT start, count(*) AS n FROM slots GROUP BY 1) SELECT count(*) AS n_rows, count(*) FILTER (WHERE n <> 4) AS bad_slots, 0::BIGINT AS dim_spread, 0::BIGINT AS bad_dims, 0::BIGINT AS not_finite, (count(start) - count(DISTINCT start))::BIGINT AS repeated_starts FROM c")
def _(spark, d):
    return io.cache_contract(cache(spark, d), 4)


@query("s5_merge_shards", f"WITH {LATENTS} SELECT id AS start, round(latent[1], 6) AS first FROM lat WHERE id % 25 <= 21")
def _(spark, d):
    lat = latents(spark, d).where("id % 25 <= 21").select(F.col("id").alias("start"), r6(F.get("latent", F.lit(0))).alias("first"))
    return io.merge_cache_shards([lat.where("start % 3 = 0"), lat.where("start % 3 > 0")], lat)


@query("s15_merge_results", "SELECT l_suppkey AS region, CASE WHEN l_suppkey % 4 = 0 THEN max(l_tax) ELSE min(l_tax) END AS loss, 'c' AS config_hash FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    per = lambda f, c: table(spark, d, "lineitem").where(c).groupBy(F.col("l_suppkey").alias("region")).agg(f("l_tax").alias("loss")).withColumn("config_hash", F.lit("c"))
    return io.merge_region_results(per(F.min, F.lit(True)), per(F.max, F.col("l_suppkey") % 4 == 0), "c")


@query("t1_finite_rows", f"WITH {FRAMES} SELECT ep, count(*) FILTER (WHERE isfinite(s0) AND isfinite(s1)) AS n_finite FROM frames GROUP BY ep")
def _(spark, d):
    return frames(spark, d).groupBy("ep").agg(F.count_if(windows.finite_rows("state")).alias("n_finite"))


@query("t2_valid_indices", f"WITH {FRAMES} SELECT frame_id FROM frames WHERE isfinite(s0) AND isfinite(s1)")
def _(spark, d):
    return windows.valid_indices(frames(spark, d))


@query("t3_valid_starts", f"WITH {FRAMES} SELECT frame_id AS start, ep FROM (SELECT *, lead(frame_id, 15) OVER (PARTITION BY ep ORDER BY step) AS a FROM frames) WHERE a = frame_id + 15")
def _(spark, d):
    return windows.valid_starts(frames(spark, d), 4, 5)


@query("t3_valid_starts_gaps", f"WITH {FRAMES}, g AS (SELECT * FROM frames WHERE step % 7 <> 3) SELECT g.frame_id AS start, g.ep FROM g JOIN g h ON h.frame_id = g.frame_id + 15 AND h.ep = g.ep")
def _(spark, d):
    return windows.valid_starts_gaps(frames(spark, d).where("step % 7 <> 3"), 4, 5)


@query("t4_episode_of", f"WITH {FRAMES}, e AS (SELECT ep, min(frame_id) AS off, count(*) AS len FROM frames GROUP BY ep) SELECT s.frame_id AS start, e.ep FROM frames s JOIN e ON s.frame_id >= off AND s.frame_id < off + len")
def _(spark, d):
    f = frames(spark, d)
    return windows.episode_of(f.select(F.col("frame_id").alias("start")), windows.episode_table(f))


@query("t5_episode_at", f"WITH {FRAMES} SELECT frame_id, ep AS episode FROM frames")
def _(spark, d):
    f = frames(spark, d)
    return windows.episode_at(f.select("frame_id"), f)


@query("t6_expand_windows", f"WITH {FRAMES} SELECT frame_id AS start, slot, frame_id + slot * 5 AS frame_id FROM (SELECT frame_id, unnest(range(0, 4))::INT AS slot FROM frames)")
def _(spark, d):
    return windows.expand_windows(frames(spark, d).select(F.col("frame_id").alias("start")), 4, 5)


_W = f"WITH {FRAMES}, s AS (SELECT frame_id AS start, ep FROM (SELECT *, lead(frame_id, 15) OVER (PARTITION BY ep ORDER BY step) AS a FROM frames) WHERE a = frame_id + 15)"


@query("t7_gather_sequences", f"{_W}, w AS (SELECT start, k, start + 5 * k AS f FROM (SELECT start, unnest(range(0, 4)) AS k FROM s)) SELECT start, count(*)::INT AS n, round(max(s0) FILTER (WHERE k = 0), 6) AS first, round(max(s0) FILTER (WHERE k = 3), 6) AS last FROM w JOIN frames ON frames.frame_id = w.f GROUP BY start")
def _(spark, d):
    f = frames(spark, d)
    seq = windows.gather_sequences(windows.expand_windows(windows.valid_starts(f, 4, 5), 4, 5), f, "state")
    at = lambda k: r6(F.get(F.get("seq", F.lit(k)), F.lit(0)))
    return seq.select("start", F.size("seq").alias("n"), at(0).alias("first"), at(3).alias("last"))


_B = f"{_W}, b AS (SELECT s.start, k // 5 AS blk, k % 5 AS j, a0 FROM (SELECT start, unnest(range(0, 15)) AS k FROM s) s JOIN frames ON frames.frame_id = s.start + k)"


@query("t8_action_blocks", f"{_B} SELECT start, blk::INT AS block, round(sum(a0 * (j + 1)), 6) AS weighed FROM b GROUP BY 1, 2")
def _(spark, d):
    f = frames(spark, d)
    b = windows.gather_action_blocks(windows.valid_starts(f, 4, 5), f, 3, 5).select("start", F.posexplode("blocks").alias("block", "a"))
    return b.select("start", "block", r6(F.aggregate(F.transform("a", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)).alias("weighed"))


@query("t9_action_stats", f"{_B} SELECT j::INT AS d, round(avg(a0), 6) AS mean, round(stddev_pop(a0) + 1e-8, 6) AS scale FROM b GROUP BY j")
def _(spark, d):
    f = frames(spark, d)
    s = windows.action_stats(windows.gather_action_blocks(windows.valid_starts(f, 4, 5), f, 3, 5))
    return s.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("d", "x")).select("d", r6(F.col("x.mean")).alias("mean"), r6(F.col("x.scale")).alias("scale"))


@query("t9_normalize_actions", f"{_B}, st AS (SELECT j, avg(a0) AS m, stddev_pop(a0) + 1e-8 AS s FROM b GROUP BY j) SELECT start, 4 AS n_blocks, round(sum(((a0 - m) / s) ** 2), 4) AS total FROM b JOIN st ON b.j = st.j GROUP BY start")
def _(spark, d):
    f = frames(spark, d)
    b = windows.gather_action_blocks(windows.valid_starts(f, 4, 5), f, 3, 5)
    a = windows.normalize_actions(b, windows.action_stats(b))
    return a.select("start", F.size("act").alias("n_blocks"), F.round(F.aggregate(F.flatten("act"), F.lit(0.0), lambda s, x: s + x * x), 4).alias("total"))


@query("t10_unique_frames", f"{_W} SELECT dense_rank() OVER (ORDER BY f) - 1 AS key, f AS frame_id FROM (SELECT DISTINCT start + 5 * k AS f FROM (SELECT start, unnest(range(0, 4)) AS k FROM s))")
def _(spark, d):
    f = frames(spark, d)
    keys, _inv = windows.unique_frame_index(windows.expand_windows(windows.valid_starts(f, 4, 5), 4, 5))
    return keys.select("key", "frame_id")


@query("t11_reconstruct", f"{_W} SELECT start, round(sum(s0 * (k + 1)), 6) AS weighed FROM (SELECT start, k, start + 5 * k AS f FROM (SELECT start, unnest(range(0, 4)) AS k FROM s)) JOIN frames ON frame_id = f GROUP BY start")
def _(spark, d):
    f = frames(spark, d)
    keys, inv = windows.unique_frame_index(windows.expand_windows(windows.valid_starts(f, 4, 5), 4, 5))
    enc = keys.join(f.select("frame_id", F.col("state").alias("vec")), "frame_id").select("key", "vec")
    return windows.reconstruct_windows(inv, enc).select("start", r6(F.aggregate(F.transform("emb", lambda v, i: F.get(v, F.lit(0)) * (i + 1)), F.lit(0.0), lambda s, x: s + x)).alias("weighed"))


@query("t12_expand_latents", f"WITH {SLOTS} SELECT start, slot::INT AS slot, ts, round(latent[1], 6) AS first FROM slots")
def _(spark, d):
    return windows.expand_latents(cache(spark, d)).select("start", "slot", "ts", r6(F.get("latent", F.lit(0))).alias("first"))


_DEDUP = f"WITH {SLOTS} SELECT ts, round(arg_min(latent, (start, slot))[1], 6) AS first, count(*) AS copies FROM slots GROUP BY ts"


@query("t13_dedup_timesteps", _DEDUP)
def _(spark, d):
    return windows.dedup_timesteps(windows.expand_latents(cache(spark, d))).select("ts", r6(F.get("latent", F.lit(0))).alias("first"), "copies")


@query("s6_unique_cache", _DEDUP)
def _(spark, d):
    from waymark.functions.common import materialize

    return materialize(windows.dedup_timesteps(windows.expand_latents(cache(spark, d)))).select("ts", r6(F.get("latent", F.lit(0))).alias("first"), "copies")


@query("t14_first_shard", f"WITH {LATENTS} SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS shard, round(latent[1] + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END, 6) AS first FROM lat")
def _(spark, d):
    lat = latents(spark, d).select("id", F.col("latent").alias("vec"))
    second = lat.withColumn("vec", F.transform("vec", lambda x: x + 1))
    return windows.lookup_first_shard(lat, [lat.where("id % 3 = 0"), second]).select("id", "shard", r6(F.get("vec", F.lit(0))).alias("first"))


@query("t15_lookup_rows", f"WITH {FRAMES}, q AS (SELECT event_id AS pos, user_id * 1000000 + event_id % 90 AS frame_id FROM events) SELECT q.pos, q.frame_id, round(s0, 6) AS v FROM q LEFT JOIN frames ON q.frame_id = frames.frame_id")
def _(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 1_000_000 + F.col("event_id") % 90).alias("frame_id"))
    return windows.lookup_rows(q, frames(spark, d)).select("pos", "frame_id", r6(F.get("state", F.lit(0))).alias("v"))


_ANCHOR = "SELECT a.start FROM s a JOIN s b ON b.start = a.start + 5 AND b.ep = a.ep JOIN s c ON c.start = a.start + 10 AND c.ep = a.ep JOIN s e ON e.start = a.start + 35 AND e.ep = a.ep"


@query("t16_rollout_anchors", f"{_W} {_ANCHOR}")
def _(spark, d):
    return windows.rollout_anchors(windows.valid_starts(frames(spark, d), 4, 5), 5, 5, 3)


@query("t17_limit_anchors", f"{_W}, f AS (SELECT * FROM s ORDER BY start LIMIT 2000), g AS (SELECT ep, min(start) AS m FROM f GROUP BY ep ORDER BY m LIMIT 11) SELECT start, ep FROM f WHERE (SELECT count(*) FROM g) <= 10 OR start < (SELECT max(m) FROM g)")
def _(spark, d):
    return windows.limit_anchors(windows.valid_starts(frames(spark, d), 4, 5), 2000, 10)


@query("t18_eval_starts", f"WITH {FRAMES} SELECT frame_id, ep, step FROM (SELECT *, max(step) OVER (PARTITION BY ep) AS m FROM frames) WHERE step <= m - 25")
def _(spark, d):
    return windows.eval_starts(frames(spark, d), 25)


@query("t19_index_by_start", f"WITH {SLOTS} SELECT start, round(latent[1], 6) AS first FROM slots WHERE slot = 0")
def _(spark, d):
    return windows.index_by_start(cache(spark, d)).select("start", r6(F.get(F.get("emb", F.lit(0)), F.lit(0))).alias("first"))


@query("t20_common_support", f"{_W}, a AS ({_ANCHOR}) SELECT h AS horizon, a.start FROM a, (SELECT unnest([1, 5]) AS h)")
def _(spark, d):
    s = windows.valid_starts(frames(spark, d), 4, 5)
    all_h = windows.rollout_anchors(s, 1).withColumn("horizon", F.lit(1)).unionByName(windows.rollout_anchors(s, 5, 5, 3).withColumn("horizon", F.lit(5)))
    return windows.common_support(all_h, 5).select("horizon", "start")


@query("t21_subset", f"WITH {SLOTS} SELECT start, count(*)::INT AS n FROM slots JOIN (SELECT id FROM lat WHERE label < 5) k ON k.id = start GROUP BY start")
def _(spark, d):
    return windows.subset(cache(spark, d), latents(spark, d).where("label < 5").select(F.col("id").alias("start"))).select("start", F.size("emb").alias("n"))


@query("t22_slice_starts", f"{_W} SELECT start, ep FROM s ORDER BY start LIMIT 100 OFFSET 50")
def _(spark, d):
    return windows.slice_starts(windows.valid_starts(frames(spark, d), 4, 5), 50, 100)


@query("t23_labelled_latents", f"WITH {SLOTS}, p AS (SELECT *, (ts * 7) % 224 AS x FROM slots) SELECT ts, CASE WHEN min(x) < 107 THEN 0 WHEN min(x) <= 117 THEN 1 ELSE 2 END AS label, round(arg_min(latent, (start, slot))[1], 6) AS first FROM p WHERE ts % 6 <> 0 GROUP BY ts")
def _(spark, d):
    from waymark.operators.regions import rooms3

    pos = latents(spark, d).select(F.col("id").alias("ts"), F.when(F.col("id") % 6 != 0, (F.col("id") * 7) % 224).cast("double").alias("x"))
    return windows.labelled_latents(cache(spark, d), pos, rooms3(F.col("x"))).select("ts", "label", r6(F.get("latent", F.lit(0))).alias("first"))


@query("p1_sample_n", "SELECT vec_id AS id, label::BIGINT AS label FROM embeddings ORDER BY md5('3:' || vec_id), vec_id LIMIT 200")
def _(spark, d):
    return sampling.sample_n(latents(spark, d), 200, 3).select("id", "label")


_EP = f"{_W}, k AS (SELECT ep, row_number() OVER (ORDER BY md5('5:' || ep), ep) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT ep FROM s))"


@query("p2_episode_split", f"{_EP} SELECT s.start, s.ep, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' ELSE 'eval' END AS split FROM s JOIN k ON s.ep = k.ep")
def _(spark, d):
    return sampling.episode_split(windows.valid_starts(frames(spark, d), 4, 5), 0.8, 5).select("start", "ep", "split")


@query("p3_episode_split3", f"{_EP} SELECT s.start, s.ep, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * (0.7 + 0.15), 0) THEN 'val' ELSE 'test' END AS split FROM s JOIN k ON s.ep = k.ep")
def _(spark, d):
    return sampling.episode_split3(windows.valid_starts(frames(spark, d), 4, 5), {"train": 0.7, "val": 0.15, "test": 0.15}, 5).select("start", "ep", "split")


@query("p4_transition_split", f"{_W} SELECT start, ep, CASE WHEN row_number() OVER (ORDER BY md5('5:' || start), start) <= round_even(count(*) OVER () * 0.9, 0) THEN 'train' ELSE 'holdout' END AS split FROM s")
def _(spark, d):
    return sampling.transition_split(windows.valid_starts(frames(spark, d), 4, 5), 0.9, 5).select("start", "ep", "split")


@query("p5_reference_iid", "WITH b AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY md5('2:' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM embeddings WHERE label < 5) SELECT e.vec_id AS id, coalesce(r <= round_even(n * 0.5, 0), false) AS reference, coalesce(r > round_even(n * 0.5, 0), false) AS iid FROM embeddings e LEFT JOIN b ON b.id = e.vec_id")
def _(spark, d):
    return sampling.reference_iid_split(latents(spark, d).withColumn("low", F.col("label") < 5), "low", 0.5, 10, 2).select("id", "reference", "iid")


@query("p6_landmark_sample", "WITH t AS (SELECT vec_id AS id, row_number() OVER (PARTITION BY vec_id // 25 ORDER BY md5('4:' || vec_id), vec_id) AS turn FROM embeddings) SELECT id, turn::INT AS turn FROM t ORDER BY turn, md5('4:' || id), id LIMIT 90")
def _(spark, d):
    return sampling.landmark_sample(latents(spark, d), 90, 4, "grp").select("id", "turn")


@query("p7_balanced_sample", "SELECT vec_id AS id, label::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('4:' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 12")
def _(spark, d):
    return sampling.balanced_sample(latents(spark, d), "label", 12, 4).select("id", "label")


@query(
    "p8_group_holdout",
    "WITH g AS (SELECT DISTINCT vec_id // 25 AS grp, label % 4 AS l FROM embeddings), u AS (SELECT DISTINCT grp FROM g), t AS (SELECT grp, try, row_number() OVER (PARTITION BY try ORDER BY md5((9 + try) || ':' || grp), grp) <= greatest(1, round_even((SELECT count(*) FROM u) * 0.2, 0)) AS holdout FROM u, (SELECT unnest(range(0, 50)) AS try)), "
    "ok AS (SELECT min(try) AS try FROM (SELECT try FROM t JOIN g ON t.grp = g.grp GROUP BY try HAVING count(DISTINCT CASE WHEN holdout THEN l END) = 4 AND count(DISTINCT CASE WHEN NOT holdout THEN l END) = 4)) SELECT grp, holdout FROM t WHERE try = (SELECT try FROM ok)",
)
def _(spark, d):
    return sampling.group_holdout(latents(spark, d).withColumn("l", F.col("label") % 4), "grp", "l", 0.2, 9)


@query("p9_holdout", "SELECT vec_id AS id FROM embeddings QUALIFY row_number() OVER (ORDER BY md5('8:' || vec_id), vec_id) <= greatest(1, floor(count(*) OVER () * 0.1))")
def _(spark, d):
    return sampling.holdout(latents(spark, d), 0.1, 8).select("id")


@query("p10_split_manifest", f"{_EP}, c AS (SELECT CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' ELSE 'eval' END AS split, count(*) AS nominal FROM s JOIN k ON s.ep = k.ep GROUP BY 1) SELECT split, nominal, least(nominal, CASE WHEN split = 'train' THEN 1000 ELSE 100000000 END) AS written, bool_or(split = 'train' AND nominal > 1000) OVER () AS subsampled FROM c")
def _(spark, d):
    return sampling.split_manifest(sampling.episode_split(windows.valid_starts(frames(spark, d), 4, 5), 0.8, 5), {"train": 1000, "eval": 100_000_000})


@query("p11_starts_for_episodes", f"{_W} SELECT start, ep FROM s WHERE ep % 3 = 0")
def _(spark, d):
    s = windows.valid_starts(frames(spark, d), 4, 5)
    return sampling.starts_for_episodes(s, s.where("ep % 3 = 0").select("ep")).select("start", "ep")


@query("d11_dedup_stats", f"{_W}, x AS (SELECT start, start + 5 * k AS f FROM (SELECT start, unnest(range(0, 4)) AS k FROM s)) SELECT count(*) AS n_slots, count(DISTINCT f) AS n_keys, count(DISTINCT start) AS n_windows, round(1 - count(DISTINCT f) / count(*), 6) AS saved_share, round(count(*) / count(DISTINCT f), 6) AS reuse FROM x")
def _(spark, d):
    f = frames(spark, d)
    _keys, inv = windows.unique_frame_index(windows.expand_windows(windows.valid_starts(f, 4, 5), 4, 5))
    return audit.dedup_stats(inv).withColumns({"saved_share": r6("saved_share"), "reuse": r6("reuse")})


@query("d1_audit_disjoint", f"{_W}, a AS (SELECT * FROM s WHERE ep % 3 > 0), b AS (SELECT * FROM s WHERE ep % 4 = 0) SELECT (SELECT count(*) FROM a) AS n_train, (SELECT count(*) FROM b) AS n_eval, (SELECT count(*) FROM (SELECT ep FROM a INTERSECT SELECT ep FROM b)) AS shared_episodes, (SELECT count(*) FROM (SELECT start FROM a INTERSECT SELECT start FROM b)) AS shared_starts")
def _(spark, d):
    s = windows.valid_starts(frames(spark, d), 4, 5)
    return audit.audit_disjoint(s.where("ep % 3 > 0"), s.where("ep % 4 = 0")).drop("first_shared")


@query("d2_train_only", f"{_W} SELECT true AS no_shared_episode, true AS same_hash, true AS train_inside, count(*) FILTER (WHERE ep % 3 = 0 AND ep % 3 > 0) = 0 AS eval_outside FROM s")
def _(spark, d):
    s = windows.valid_starts(frames(spark, d), 4, 5)
    return audit.audit_train_only(s.where("ep % 3 > 0"), s.where("ep % 3 = 0"), s.where("ep % 3 > 0").select("ep").distinct(), ("h", "h"))


@query("d3_audit_exact", "SELECT event_id AS pos, user_id AS got, CASE WHEN event_id % 50 = 0 THEN user_id + 1 ELSE user_id END AS want FROM events WHERE event_id % 50 = 0")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("id"))
    return audit.audit_exact(e, e.withColumn("id", F.when(F.col("pos") % 50 == 0, F.col("id") + 1).otherwise(F.col("id"))))


@query("d4_compare_tables", f"WITH {LATENTS} SELECT count(*) AS n, count(*) FILTER (WHERE id % 100 = 7) AS n_unmatched, count(*) FILTER (WHERE id % 10 = 0) AS n_mismatch, count(*) FILTER (WHERE id % 10 = 0) AS n_far, 0.5::DOUBLE AS max_abs, false AS exact, false AS allclose FROM lat")
def _(spark, d):
    lat = latents(spark, d).select("id", "latent")
    other = lat.where("id % 100 <> 7").withColumn("latent", F.transform("latent", lambda x, i: F.when((F.col("id") % 10 == 0) & (i == 3), x + 0.5).otherwise(x)))
    return audit.compare_tables(lat, other, "id", "latent").withColumn("max_abs", r6("max_abs"))


@query("p_seeded_uniform", "SELECT vec_id AS id, md5('11:' || vec_id) AS k FROM embeddings")
def _(spark, d):
    return latents(spark, d).select("id", seeded(11, "id").alias("k"))
