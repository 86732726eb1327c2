"""Routing of latents to regions (V1-V7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.common import dot, sq_dist
from waymark.operators.agreement import classification_metrics
from waymark.operators.sampling import holdout
from waymark.operators.vectors import zscore_l2

#: Prototypes that may be broadcast; a partition has K * P of them.
MOST_PROTOTYPES = 100_000


def _table(prototypes: DataFrame) -> list:
    rows = prototypes.select("idx", "vec", "owner").orderBy("idx").limit(MOST_PROTOTYPES + 1).collect()
    if not rows or len(rows) > MOST_PROTOTYPES:
        raise ValueError(f"a router needs 1 to {MOST_PROTOTYPES} prototypes")
    return rows


def nearest_owner(df: DataFrame, prototypes: DataFrame, col: str = "z", out: str = "region", spherical: bool = True) -> DataFrame:
    """The owner of the nearest prototype by Arrow batches of matrix products; the lowest index wins ties."""
    rows = _table(prototypes)
    c, owner = np.array([r["vec"] for r in rows], dtype=np.float64), np.array([r["owner"] for r in rows])

    @F.pandas_udf("long")
    def route(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(a, dtype=np.float64) for a in v])
        s = x @ c.T if spherical else 2 * x @ c.T - (c * c).sum(axis=1)
        return pd.Series(owner[np.round(s, 12).argmax(axis=1)])

    return df.withColumn(out, route(F.col(col)))


def nearest_owner_sql(df: DataFrame, prototypes: DataFrame, col: str = "z", out: str = "region", spherical: bool = True) -> DataFrame:
    """The same in built-in expressions: the prototypes are an array literal, so nothing is joined or regrouped."""
    protos = F.array(*[F.struct(F.lit(int(r["idx"])).alias("idx"), F.array(*[F.lit(float(x)) for x in r["vec"]]).alias("vec"), F.lit(int(r["owner"])).cast("long").alias("owner")) for r in _table(prototypes)])
    score = lambda v: F.round(dot(F.col(col), v), 12) if spherical else F.round(-sq_dist(F.col(col), v), 12)
    best = F.array_max(F.transform(protos, lambda p: F.struct(score(p["vec"]).alias("s"), (-p["idx"]).alias("i"), p["owner"].alias("o"))))
    return df.withColumn(out, best["o"])


def route(df: DataFrame, prototypes: DataFrame, stats: DataFrame | None = None, col: str = "latent", sql: bool = False) -> DataFrame:
    """V1: z-score and L2-normalise with the artifact's statistics, then the owner of the nearest prototype."""
    ready, at = (zscore_l2(df, stats, col, "_z"), "_z") if stats is not None else (df, col)
    return (nearest_owner_sql if sql else nearest_owner)(ready, prototypes, at).drop("_z")


def assign(df: DataFrame, centroids: DataFrame, spherical: bool = True, col: str = "z") -> DataFrame:
    """V2: the nearest centroid (idx, vec), by cosine or squared distance."""
    return nearest_owner(df, centroids.withColumn("owner", F.col("idx")), col, "region", spherical)


def route_rollout(slots: DataFrame, prototypes: DataFrame, mode: str, col: str = "latent") -> DataFrame:
    """V3: (start, slot, region) of recorded slots: mode mpc routes slot 0 and keeps it, oracle routes every slot.

    Mode step needs a model's own predictions and is part of the switched rollout.
    """
    if mode == "oracle":
        return nearest_owner(slots, prototypes, col).select("start", "slot", "region")
    if mode != "mpc":
        raise ValueError("mode is mpc or oracle")
    first = nearest_owner(slots.where("slot = 0"), prototypes, col).select("start", "region")
    return slots.select("start", "slot").join(first, "start")


def route_stats(routes: DataFrame) -> DataFrame:
    """V4: per episode (ep, step, region): steps, switches and switch rate."""
    before = F.lag("region").over(Window.partitionBy("ep").orderBy("step"))
    per = routes.withColumn("switched", F.coalesce(before != F.col("region"), F.lit(False))).groupBy("ep").agg(F.count("*").alias("n_steps"), F.count_if("switched").alias("n_switches"))
    return per.withColumn("switch_rate", F.when(F.col("n_steps") > 1, F.col("n_switches") / (F.col("n_steps") - 1)).otherwise(F.lit(0.0)))


def route_histogram(routes: DataFrame) -> DataFrame:
    """V4: rows and share of each region."""
    n = routes.groupBy("region").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def model_for(routed: DataFrame, models: DataFrame) -> DataFrame:
    """V5: each routed row with its region's model; a region without one is an error."""
    met = routed.join(models, "region", "left")
    key = next(c for c in models.columns if c != "region")
    return met.where(F.when(F.col(key).isNull(), F.raise_error(F.lit("a region has no model")).cast("boolean")).otherwise(True))


def with_margins(df: DataFrame, centroids: DataFrame, col: str = "z", out: str = "m") -> DataFrame:
    """V6: the best minus the second-best cosine; centroids are one row of a broadcast, of checked length, not part of the plan."""
    if centroids.limit(MOST_PROTOTYPES + 1).count() > MOST_PROTOTYPES:
        raise ValueError(f"at most {MOST_PROTOTYPES} centroids")
    protos = centroids.agg(F.collect_list("vec").alias("_protos"))
    s = F.sort_array(F.transform("_protos", lambda p: dot(F.col(col), p)), asc=False)
    return df.crossJoin(F.broadcast(protos)).withColumn(out, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).drop("_protos")


def margin_stats(df: DataFrame, centroids: DataFrame, col: str = "z") -> DataFrame:
    """V6: mean, median, p10, p25 of the margins and the share below 0.01."""
    m = with_margins(df.select(col), centroids, col)
    q = F.percentile("m", [0.1, 0.25, 0.5])
    return m.agg(F.avg("m").alias("mean"), q.alias("q"), F.avg((F.col("m") < 0.01).cast("double")).alias("share_below")).select("mean", F.get("q", F.lit(2)).alias("median"), F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("p25"), "share_below")


def router_fidelity(routed: DataFrame, labels: DataFrame, frac: float = 0.2, seed: int = 0) -> DataFrame:
    """V7: agreement with offline labels over all rows, and macro-F1 on a holdout."""
    both = routed.select("id", F.col("region").alias("p")).join(labels.select("id", F.col("region").alias("y")), "id")
    all_rows = both.agg(F.avg((F.col("p") == F.col("y")).cast("double")).alias("agreement"))
    return all_rows.crossJoin(classification_metrics(holdout(both, frac, seed)).select("macro_f1"))  # one row each
