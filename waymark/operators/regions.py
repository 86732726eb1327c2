"""Rule-based regions (R1-R10): thresholds from a reference set, masks as boolean columns, labels as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.windows import finite_rows

#: The doorway is LEFT_WALL <= x <= RIGHT_WALL on a square of SIZE with a BORDER.
LEFT_WALL, RIGHT_WALL, SIZE, BORDER, WALL_WIDTH = 107.0, 117.0, 224.0, 14.0, 10.0
#: Quantiles of x and of y that the thresholds are.
X_QUANTILES = (0.1, 0.2, 0.4, 0.45, 0.5, 0.55, 0.6, 0.8, 0.9)
Y_QUANTILES = (0.1, 0.25, 0.75, 0.9)


def quantile_thresholds(ref: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row with arrays qx and qy of exact, linearly interpolated quantiles of the reference rows."""
    return ref.agg(F.percentile(x, list(X_QUANTILES)).alias("qx"), F.percentile(y, list(Y_QUANTILES)).alias("qy"))


def quantile_regions(df: DataFrame, ref: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Overlapping masks from the quantiles of ``ref``, which is a required argument so that no test row leaks in."""
    one = df.crossJoin(F.broadcast(quantile_thresholds(ref, x, y)))  # one row
    q = lambda c, names, v: F.get(c, F.lit(names.index(v)))
    qx, qy = (lambda v: q("qx", X_QUANTILES, v)), (lambda v: q("qy", Y_QUANTILES, v))
    cx, cy = F.col(x), F.col(y)
    return one.withColumns(
        {
            "common": cx.between(qx(0.2), qx(0.8)) & cy.between(qy(0.25), qy(0.75)),
            "left_room": cx < qx(0.45),
            "right_room": cx > qx(0.55),
            "doorway": cx.between(qx(0.45), qx(0.55)),
            "near_wall": (cx <= qx(0.1)) | (cx >= qx(0.9)) | (cy <= qy(0.1)) | (cy >= qy(0.9)),
            "goal_other_side": (cx < qx(0.4)) | (cx > qx(0.6)),
        }
    ).drop("qx", "qy")


def geometry_regions(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """R2: overlapping masks from fixed wall and border sizes."""
    cx, cy = F.col(x), F.col(y)
    near = BORDER + WALL_WIDTH
    return df.withColumns(
        {
            "left_room": cx < LEFT_WALL,
            "right_room": cx > RIGHT_WALL,
            "doorway": cx.between(LEFT_WALL, RIGHT_WALL),
            "near_wall": (cx <= near) | (cx >= SIZE - near) | (cy <= near) | (cy >= SIZE - near),
            "common": cx.between(SIZE / 4, 3 * SIZE / 4) & cy.between(SIZE / 4, 3 * SIZE / 4),
        }
    )


def object_regions(df: DataFrame, ref: DataFrame) -> DataFrame:
    """Masks of object position (ox, oy), contact distance and angle: median quadrants, 20/80 % tails, inter-quartile box."""
    t = ref.agg(F.percentile("ox", [0.25, 0.5, 0.75]).alias("tx"), F.percentile("oy", [0.25, 0.5, 0.75]).alias("ty"), F.percentile("dist", [0.2, 0.8]).alias("td"), F.percentile("angle", [0.2, 0.8]).alias("ta"))
    at = lambda c, i: F.get(c, F.lit(i))
    out = df.crossJoin(F.broadcast(t)).withColumns(
        {
            "obj_left": F.col("ox") < at("tx", 1),
            "obj_right": F.col("ox") >= at("tx", 1),
            "obj_low": F.col("oy") < at("ty", 1),
            "obj_high": F.col("oy") >= at("ty", 1),
            "contact": F.col("dist") <= at("td", 0),
            "far": F.col("dist") >= at("td", 1),
            "angle_low": F.col("angle") <= at("ta", 0),
            "angle_high": F.col("angle") >= at("ta", 1),
            "central": F.col("ox").between(at("tx", 0), at("tx", 2)) & F.col("oy").between(at("ty", 0), at("ty", 2)),
        }
    )
    return out.drop("tx", "ty", "td", "ta")


def common_region(df: DataFrame) -> DataFrame:
    """All rows are one region."""
    return df.withColumn("common", F.lit(True))


def rooms3(x: Column) -> Column:
    """0 left, 1 doorway, 2 right."""
    return F.when(x.isNull() | F.isnan(x), None).when(x < LEFT_WALL, 0).when(x <= RIGHT_WALL, 1).otherwise(2)


def priority5(x: Column, y: Column) -> Column:
    """Doorway before near wall before common before right before left."""
    near = BORDER + WALL_WIDTH
    return (
        F.when(x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y), None)
        .when(x.between(LEFT_WALL, RIGHT_WALL), "doorway")
        .when((x <= near) | (x >= SIZE - near) | (y <= near) | (y >= SIZE - near), "near_wall")
        .when(x.between(SIZE / 4, 3 * SIZE / 4) & y.between(SIZE / 4, 3 * SIZE / 4), "common")
        .when(x > RIGHT_WALL, "right_room")
        .otherwise("left_room")
    )


def region_masks_at(starts: DataFrame, frames: DataFrame, ref: DataFrame, mode: str = "quantile") -> DataFrame:
    """Masks at starts with a finite state; thresholds come from the reference starts alone."""
    at = frames.where(finite_rows("state")).select(F.col("frame_id").alias("start"), F.get("state", F.lit(0)).alias("x"), F.get("state", F.lit(1)).alias("y"))
    rows = starts.select("start").join(at, "start")
    if mode == "geometry":
        return geometry_regions(rows)
    return quantile_regions(rows, ref.select("start").join(at, "start"))


def middle_mask(df: DataFrame, ref: DataFrame, col: str, low: float, high: float, out: str = "middle") -> DataFrame:
    """Between two quantiles of the reference rows, both included."""
    t = ref.agg(F.percentile(col, [low, high]).alias("_t"))
    return df.crossJoin(F.broadcast(t)).withColumn(out, F.col(col).between(F.get("_t", F.lit(0)), F.get("_t", F.lit(1)))).drop("_t")


def extreme_mask(df: DataFrame, ref: DataFrame, col: str, low: float, high: float, out: str = "extreme") -> DataFrame:
    """At or beyond two quantiles of the reference rows."""
    t = ref.agg(F.percentile(col, [low, high]).alias("_t"))
    return df.crossJoin(F.broadcast(t)).withColumn(out, (F.col(col) <= F.get("_t", F.lit(0))) | (F.col(col) >= F.get("_t", F.lit(1)))).drop("_t")


def rooms3_keys(seqs: DataFrame, steps: int, mode: str = "step", history: int = 1) -> DataFrame:
    """(start, step, region): slot 0 at every step in mode mpc, else slot 0 first and then slot history + step - 1."""
    slot = lambda k: 0 if mode == "mpc" or k == 0 else history + k - 1
    keys = F.array(*[F.struct(F.lit(k).alias("step"), rooms3(F.get(F.get("seq", F.lit(slot(k))), F.lit(0))).alias("region")) for k in range(steps)])
    return seqs.select("start", F.inline(keys))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per label."""
    return df.groupBy(label).agg(F.count("*").alias("n"))
