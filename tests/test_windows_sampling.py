import itertools
import pytest
from pyspark.sql import functions as F

from waymark.operators import audit, sampling, windows
from waymark.sources import io


def frame_log(spark):
    rows = [(i, i // 5, i % 5, [float(i), 0.0], [1.0]) for i in range(10)]
    return spark.createDataFrame(rows, "frame_id long, ep long, step long, state array<double>, action array<double>")


def test_valid_starts(spark):
    f = frame_log(spark)
    want = [0, 1, 2, 3, 5, 6, 7, 8]
    assert sorted(r.start for r in windows.valid_starts(f, 2, 1).collect()) == want
    assert sorted(r.start for r in windows.valid_starts_gaps(f, 2, 1).collect()) == want
    bad = f.withColumn("state", F.when(F.col("frame_id") == 3, F.array(F.lit(float("nan")), F.lit(0.0))).otherwise(F.col("state")))
    assert sorted(r.start for r in windows.valid_starts(bad, 2, 1).collect()) == [0, 1, 2, 5, 6, 7, 8]


def test_dedup_keeps_the_first(spark):
    cache = spark.createDataFrame([(0, [[0.0, 0.0], [1.0, 0.0]]), (1, [[1.0, 0.0], [2.0, 0.0]]), (2, [[2.1, 0.0], [3.0, 0.0]])], "start long, emb array<array<double>>")
    got = {r.ts: r.latent for r in windows.dedup_timesteps(windows.expand_latents(cache)).collect()}
    assert got == {0: [0, 0], 1: [1, 0], 2: [2, 0], 3: [3, 0]}


def test_unique_frames_round_trip(spark):
    starts = spark.createDataFrame([(0,), (1,), (2,)], "start long")
    w = windows.expand_windows(starts, 2)
    keys, inv = windows.unique_frame_index(w)
    assert keys.count() == 4 and audit.dedup_stats(inv).first().n_slots == 6
    enc = keys.select("key", F.array(F.col("frame_id").cast("double"), (F.col("frame_id") * F.col("frame_id")).cast("double")).alias("vec"))
    got = {r.start: r.emb for r in windows.reconstruct_windows(inv, enc).collect()}
    assert got[2] == [[2.0, 4.0], [3.0, 9.0]]


def test_anchors_against_brute_force(spark):
    own = {s: 0 for s in range(12)} | {s: 1 for s in range(20, 34) if s != 27} | {40: 2, 41: 2}
    starts = spark.createDataFrame(list(own.items()), "start long, ep long")
    found = {}
    for horizon, skip, history in itertools.product((1, 2, 4), (1, 3), (1, 2)):
        need = [k * skip for k in range(history)] + [(history - 1 + horizon) * skip] if horizon > 1 else [0]
        want = {s for s, ep in own.items() if all(own.get(s + k) == ep for k in need)}
        found[horizon, skip, history] = got = {r.start for r in windows.rollout_anchors(starts, horizon, skip, history).collect()}
        assert got == want, (horizon, skip, history)
    assert found[4, 1, 1] < found[1, 1, 1] and 26 not in found[2, 1, 2]


def test_episode_of_is_a_range_join(spark):
    eps = spark.createDataFrame([(0, 0, 5), (1, 5, 5000)], "ep long, off long, len long")
    starts = spark.createDataFrame([(0,), (4,), (5,), (5004,), (5005,)], "start long")
    assert sorted((r.start, r.ep) for r in windows.episode_of(starts, eps).collect()) == [(0, 0), (4, 0), (5, 1), (5004, 1)]


def test_splits_are_disjoint_and_repeat(spark):
    s = spark.range(200).select(F.col("id").alias("start"), (F.col("id") % 20).alias("ep"))
    a = {(r.start, r.split) for r in sampling.episode_split(s, 0.7, 3).collect()}
    assert a == {(r.start, r.split) for r in sampling.episode_split(s.repartition(7), 0.7, 3).collect()}
    eps = {k: {x % 20 for x, n in a if n == k} for k in ("train", "eval")}
    assert len(eps["train"]) == 14 and not eps["train"] & eps["eval"]
    with pytest.raises(ValueError):
        sampling.episode_split(s, 0.0, 3)


def test_landmarks_go_round(spark):
    df = spark.createDataFrame([(i, 0) for i in range(50)] + [(100 + i, 1 + i) for i in range(5)], "id long, grp long")
    got = sampling.landmark_sample(df, 8, 1, "grp").collect()
    assert len(got) == 8 and {r.grp for r in got if r.turn == 1} == set(range(6))


def test_shards_and_audits_fail_closed(spark):
    s = spark.range(4).select(F.col("id").alias("start"))
    with pytest.raises(ValueError):
        io.merge_cache_shards([s, s.limit(1)], s)
    a = spark.createDataFrame([(0, 0), (1, 0)], "start long, ep long")
    with pytest.raises(ValueError):
        audit.audit_disjoint(a, a, required=True)
    with pytest.raises(ValueError):
        io.resolve_cluster_source()
    with pytest.raises(Exception):
        windows.lookup_first_shard(spark.createDataFrame([(9,)], "id long"), [spark.createDataFrame([(1, [0.0])], "id long, vec array<double>")])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, [[0.0, 1.0]], [[0.0, 1.0]])], "start long, emb array<array<double>>, act_emb array<array<double>>")
    io.write_cache(df, str(tmp_path / "c"))
    with pytest.raises(Exception):
        io.write_cache(df, str(tmp_path / "c"))
    assert io.read_latent_cache(spark, str(tmp_path / "c"), 1, 0).count() == 1
    with pytest.raises(ValueError):
        io.read_latent_cache(spark, str(tmp_path / "c"), 2, 2)
    (tmp_path / "seed3").mkdir()
    (tmp_path / "seed3" / "results.json").write_text('{"metrics": {"success_rate": 50.0}, "seed": 3, "num_eval": 50, "eval_start_indices": [1, 2]}')
    assert io.collect_runs(spark, str(tmp_path / "seed3"), num_eval=50).first().success_rate == 50
    with pytest.raises(ValueError):
        io.collect_runs(spark, str(tmp_path / "seed3"), num_eval=51)
    assert not io.write_csv(df.limit(0).select("start"), str(tmp_path / "none"))


def test_empty_tables(spark):
    f = frame_log(spark).limit(0)
    assert windows.valid_starts(f, 2).count() == 0
    assert sampling.sample_n(f, 5, 1, "frame_id").count() == 0
    assert windows.episode_table(f).count() == 0


def test_windows_are_not_broadcast(spark, capsys):
    """The plan takes exploded windows to be as small as their starts."""
    from waymark.functions.common import materialize

    starts = materialize(spark.range(0, 3000, 3).withColumnRenamed("id", "start"))
    w = windows.expand_windows(starts, 40)
    keys, inverse = windows.unique_frame_index(w)
    frames = materialize(spark.range(3040).select(F.col("id").alias("frame_id"), F.array(F.lit(1.0)).alias("state")))
    for df in (inverse, windows.gather_sequences(w, frames, "state")):
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        for line in plan.splitlines():
            if "BroadcastHashJoin" in line or "BroadcastExchange" in line:
                assert "frame_id" not in line
        assert "SortMergeJoin" in plan
    assert inverse.count() == 40_000 and windows.gather_sequences(w, frames, "state").count() == 1000
