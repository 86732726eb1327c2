"""Online routing (V8): the batch decision on a stream of latents, windowed histograms, and switches by state."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from waymark.operators.routing import nearest_owner_sql


def read_latent_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def route_stream(stream: DataFrame, prototypes: DataFrame, col: str = "latent") -> DataFrame:
    """Each row's region; stateless, with the prototypes in the plan."""
    return nearest_owner_sql(stream, prototypes, col)


def windowed_histogram(routed: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window start, region, n) with late rows dropped behind the watermark."""
    return routed.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "region").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "region", "n")


def switch_stream(routed: DataFrame, key: str = "ep", order: str = "step") -> DataFrame:
    """(key, n_steps, n_switches) so far, after each batch that has rows of the key; the state is one row a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, steps, switches = state.get if state.exists else (-1, 0, 0)
        for r in pd.concat(list(batches)).sort_values(order)["region"].tolist():
            switches += last >= 0 and r != last
            last, steps = int(r), steps + 1
        state.update((last, steps, switches))
        yield pd.DataFrame({key: [k[0]], "n_steps": [steps], "n_switches": [switches]})

    return routed.groupBy(key).applyInPandasWithState(step, f"{key} long, n_steps long, n_switches long", "last long, steps long, switches long", "update", "NoTimeout")


def ordered_switches(routed: DataFrame, key: str = "ep", order: str = "step", time: str = "ts", late: str = "2 days") -> DataFrame:
    """(key, n_steps, n_switches) of the steps up to the watermark, whatever order they came in.

    Steps wait in the key's state until the watermark passes their ``time`` and
    are then counted by (time, ``order``); a step that comes after the watermark
    passed its time is dropped, as in every windowed sum.  The state of a key is
    its last region, its counts and the steps of the last ``late``.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, steps, switches, times, orders, regions = state.get if state.exists else (-1, 0, 0, [], [], [])
        waiting = list(zip(times, orders, regions, strict=True))
        for pdf in batches:
            waiting += zip((pdf["_time"].astype("int64")).tolist(), pdf[order].tolist(), pdf["region"].tolist(), strict=True)
        waiting.sort()
        passed = bisect.bisect_right(waiting, state.getCurrentWatermarkMs(), key=lambda w: w[0])
        for _, _, region in waiting[:passed]:
            switches += last >= 0 and region != last
            last, steps = int(region), steps + 1
        waiting = waiting[passed:]
        state.update((last, steps, int(switches), [w[0] for w in waiting], [w[1] for w in waiting], [int(w[2]) for w in waiting]))
        if waiting:
            state.setTimeoutTimestamp(waiting[0][0] + 1)
        if passed:
            yield pd.DataFrame({key: [k[0]], "n_steps": [steps], "n_switches": [int(switches)]})

    rows = routed.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("_time", F.unix_millis(F.col(time)))
    state = "last long, steps long, switches long, times array<long>, orders array<long>, regions array<long>"
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, n_steps long, n_switches long", state, "update", "EventTimeTimeout")
