import pytest
from pyspark.sql import functions as F

from waymark.sources import io, versions


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "region long, score double")


def read(spark, path, version=None):
    return sorted(map(tuple, versions.read_version(spark, path, version).collect()))


def test_versions_keep_what_was_published(spark, tmp_path):
    path = str(tmp_path / "store")
    assert versions.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.publish(rows(spark, (0, 1.0), (1, 2.0)), path, "c") == 1
    assert versions.publish(rows(spark, (1, 2.0), (2, 3.0)), path, "c") == 2  # an equal row may come again
    assert read(spark, path) == [(0, 1.0), (1, 2.0), (2, 3.0)] and read(spark, path, 1) == [(0, 1.0), (1, 2.0)]
    for bad, config, said in ((rows(spark, (1, 9.0)), "c", "stay"), (rows(spark, (5, 1.0)), "other", "configuration"), (rows(spark, (5, 1.0), (5, 2.0)), "c", "unique"), (rows(spark, (None, 1.0)), "c", "unique")):
        with pytest.raises(ValueError, match=said):
            versions.publish(bad, path, config)
    assert versions.versions(spark, path) == [1, 2] and len(read(spark, path)) == 3
    assert versions.publish(rows(spark, (1, 9.0)), path, "c", replace=rows(spark, (1, None))) == 3
    assert read(spark, path) == [(0, 1.0), (1, 9.0), (2, 3.0)] and read(spark, path, 2)[1] == (1, 2.0)


def test_a_writer_that_dies_or_comes_second_leaves_the_latest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    versions.publish(rows(spark, (0, 1.0)), path, "c")
    rename = versions._rename

    def dies(*a):
        raise OSError("lost")

    monkeypatch.setattr(versions, "_rename", dies)
    with pytest.raises(OSError):
        versions.publish(rows(spark, (7, 7.0)), path, "c")
    assert read(spark, path) == [(0, 1.0)]

    def second(s, source, target):
        monkeypatch.setattr(versions, "_rename", rename)
        versions.publish(rows(spark, (1, 1.0)), path, "c")
        return rename(s, source, target)

    monkeypatch.setattr(versions, "_rename", second)
    with pytest.raises(RuntimeError, match="another writer"):
        versions.publish(rows(spark, (2, 2.0)), path, "c")
    assert read(spark, path) == [(0, 1.0), (1, 1.0)] and versions.versions(spark, path) == [1, 2]


def scanned(df):
    """Rows that the Parquet scan of a plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    out, open_ = 0, [plan]
    while open_:
        p = open_.pop()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            out += p.metrics().apply("numOutputRows").value()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            open_.append(p.plan())
        children = p.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return out


def test_row_ids_prune_the_scan(spark, tmp_path):
    path = str(tmp_path / "frames")
    spark.range(40_000).select(F.col("id").alias("frame_id"), (F.col("id") * 2).alias("x"), F.lit("unused").alias("y")).repartitionByRange(8, "frame_id").sortWithinPartitions("frame_id").write.parquet(path)
    ids = spark.createDataFrame([(15_000,), (15_003,), (15_010,), (None,)], "frame_id long")
    got = io.read_frames(spark, path, ["frame_id", "x", "gone"], ids)
    assert sorted(map(tuple, got.collect())) == [(15_000, 30_000), (15_003, 30_006), (15_010, 30_020)] and got.columns == ["frame_id", "x"]
    assert scanned(got) <= 10_000 < 40_000
    many = spark.range(20_000, 26_000).select(F.col("id").alias("frame_id"))  # too many to list: their range prunes
    got = io.read_frames(spark, path, ["frame_id", "x"], many)
    assert got.count() == 6000 and scanned(got) <= 20_000
    assert io.read_frames(spark, path, ["frame_id"], ids.limit(0)).count() == 0
