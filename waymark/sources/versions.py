"""Keyed results in published versions: a version is complete or not there, and a published key stays as it is.

A store is a folder.  Rows of an update lie in a segment of their own below
``data``; a version below ``versions`` is a table (key, segment, row_hash,
config_hash) that says which segment holds each key.  An update writes its
segment, then its version under a name that no reader looks at, and last
renames that: the only step that readers can see.  A writer that dies before it
leaves the old version as the latest; one that comes second finds the name taken
and is told so.  The rename has to be atomic, as on HDFS and local disks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.common import checked


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/versions")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(f"{path}/versions"))]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/versions/v{version:09d}")


def read_version(spark: SparkSession, path: str, version: int | None = None, key: str = "region") -> DataFrame:
    """The rows of a published version, the latest unless one is named."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version or ''} at {path}")
    told = _manifest(spark, path, known[-1] if version is None else version)
    segments = [r[0] for r in told.select("segment").distinct().collect()]  # one per update that still counts
    rows = None
    for s in segments:
        part = spark.read.parquet(f"{path}/data/{s}").withColumn("_segment", F.lit(s))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.join(told.select(F.col("key").alias(key), F.col("segment").alias("_segment")), [key, "_segment"], "left_semi").drop("_segment")


def publish(updates: DataFrame, path: str, config_hash: str, key: str = "region", replace: DataFrame | None = None) -> int:
    """Add keyed rows to the store; returns the number of the new version.

    Keys that are there already must come with equal rows, unless ``replace``
    (a table of keys) names them; a repeated or null key and results of another
    configuration are ValueErrors, and a version that another writer published
    meanwhile a RuntimeError.  Nothing of a failed update is ever read.
    """
    spark, segment = updates.sparkSession, uuid.uuid4().hex
    updates = checked(updates, updates.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)), "keys are unique and not null")
    rows = F.sha2(F.to_json(F.struct(*sorted(updates.columns)), {"ignoreNullFields": "false"}), 256)
    updates.write.parquet(f"{path}/data/{segment}")
    written = spark.read.parquet(f"{path}/data/{segment}")
    new = written.select(F.col(key).alias("key"), F.lit(segment).alias("segment"), rows.alias("row_hash"), F.lit(config_hash).alias("config_hash"))
    known = versions(spark, path)
    if known:
        old = _manifest(spark, path, known[-1])
        checked(old, old.where(~F.col("config_hash").eqNullSafe(F.lit(config_hash))), "results of another configuration")
        changed = new.join(old.select("key", F.col("row_hash").alias("was")), "key").where(F.col("was") != F.col("row_hash"))
        if replace is not None:
            changed = changed.join(replace.select(F.col(key).alias("key")), "key", "left_anti")
        checked(new, changed, "published keys stay as they are unless their replacement is asked for")
        new = old.join(new, "key", "left_anti").unionByName(new)
    number = known[-1] + 1 if known else 1
    hidden = f"{path}/versions/.{segment}"
    new.write.parquet(hidden)
    if not _rename(spark, hidden, f"{path}/versions/v{number:09d}"):
        raise RuntimeError(f"version {number} was published by another writer")
    return number


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    fs, at = _fs(spark, source)
    return not fs.exists(at(target)) and fs.rename(at(source), at(target))
