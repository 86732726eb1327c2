"""Column and table helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seeded(seed: int, *cols: str | Column) -> Column:
    """A reproducible random key: the md5 of seed and values, equal in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).cast("binary"))


def uniform(seed: int, *cols: str | Column) -> Column:
    """A reproducible uniform number in [0, 1) from the first 32 bits of the key."""
    return F.conv(F.substring(seeded(seed, *cols), 1, 8), 16, 10).cast("double") / float(1 << 32)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a local one if the master is local, else an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = current.get() if current.isDefined() else None
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="waymark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/waymark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._waymark_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_waymark_path", None)
        if path:
            jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add the rank from 1 in a total order without sending all rows to one task.

    Rows are range-partitioned and sorted, written once, and numbered by their
    place in the partition plus the sizes of the partitions before, which are
    one small row each.
    """
    place = F.monotonically_increasing_id()
    low = (1 << 33) - 1
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"_p": F.shiftright(place, 33), "_i": place.bitwiseAND(F.lit(low))}))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_b")
    return ranged.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def require(ok: Column, message: str) -> Column:
    """True, or an error at run time."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def checked(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """``df``, or ValueError if ``bad`` has a row."""
    if bad.limit(1).count():
        raise ValueError(message)
    return df
