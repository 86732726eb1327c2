"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id among longs.
NO_ID = -(2**63)


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


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, which cuts its lineage.

    The files outlive the executors that wrote them; unlike a local checkpoint
    nothing is recomputed or lost with an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
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


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        row_keys = list(zip(*cols, strict=True))
        for i, key in enumerate(row_keys):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, c): for each vertex of the undirected ``edges`` (a, b), the least vertex it reaches.

    Rounds of large and small stars (Kiveris et al., Connected Components in
    MapReduce and Beyond).  Each step gives at most one edge for an edge, and
    equal ones are merged, so what a round joins shrinks from the edges to the
    vertices; rounds are of the order of the squared logarithm of the vertices
    at worst.  Each step is a join whose large side AQE can split and sums with
    map-side combining; nothing is collected but one count.
    """
    live = materialize(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    if not live.limit(1).count():
        return live.selectExpr("b AS v", "a AS c")
    for _ in range(max_rounds):
        # every vertex ties its larger neighbours to the least of itself and all its neighbours
        least = live.union(live.selectExpr("b AS a", "a AS b")).groupBy("a").agg({"b": "min"}).selectExpr("a", "least(a, `min(b)`) AS c")
        large = _merged(live.join(least, "a").selectExpr("c AS a", "b", "c < a AS moved"))
        discard(live)
        # every vertex ties its smaller neighbours and itself to the least of them
        least = large.groupBy("b").agg({"a": "min"}).selectExpr("b", "`min(a)` AS c")
        small = _merged(large.select("a", "b").join(least, "b").selectExpr("c AS a", "if(a = c, b, a) AS b", "a <> c AS moved"))
        changed = large.where("moved").limit(1).count() or small.where("moved").limit(1).count()
        discard(large)
        live = small.select("a", "b")
        live._waymark_path = small._waymark_path
        if not changed:  # each vertex has one smaller neighbour, which has none
            labels = materialize(live.selectExpr("b AS v", "a AS c").union(live.selectExpr("a AS v", "a AS c").distinct()))
            discard(live)
            return labels
    raise RuntimeError(f"edges still changed after {max_rounds} rounds")


def _merged(edges: DataFrame) -> DataFrame:
    """Edges (a, b), each once and written; moved if any of its rows is."""
    return materialize(edges.groupBy("a", "b").agg({"moved": "max"}).selectExpr("a", "b", "`max(moved)` AS moved"))
