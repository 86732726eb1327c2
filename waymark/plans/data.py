"""The given tables seen as this domain's tables; each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames: a user's events in time order are an episode; ids are contiguous within it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    e = e.withColumns({"step": (F.row_number().over(w) - 1).cast("long"), "a0": F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))})
    return e.select((F.col("user_id") * 1_000_000 + F.col("step")).alias("frame_id"), F.col("user_id").alias("ep"), "step", F.array("value", F.hour("ts").cast("double")).alias("state"), F.array("a0").alias("action"))


FRAMES = """frames AS (SELECT user_id * 1000000 + row_number() OVER w - 1 AS frame_id, user_id AS ep, row_number() OVER w - 1 AS step, value AS s0, hour(ts)::DOUBLE AS s1,
  value - coalesce(lag(value) OVER w, value) AS a0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def latents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("latent"), F.floor(F.col("vec_id") / 25).alias("grp"), F.col("label").cast("long").alias("label"))


LATENTS = "lat AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS latent, vec_id // 25 AS grp, label::BIGINT AS label FROM embeddings)"
LONG = f"""{LATENTS}, e AS (SELECT id, unnest(range(1, len(latent) + 1)) AS d, unnest(latent) AS x FROM lat)"""
ZSCORED = f"""{LONG}, st AS (SELECT d, avg(x) AS m, stddev_pop(x) + 1e-6 AS s FROM e GROUP BY d), zz AS (SELECT id, e.d, (x - m) / s AS y FROM e JOIN st ON e.d = st.d),
nn AS (SELECT id, greatest(sqrt(sum(y * y)), 1e-12) AS n FROM zz GROUP BY id), z AS (SELECT zz.id, list(y / n ORDER BY d) AS z FROM zz JOIN nn ON zz.id = nn.id GROUP BY zz.id)"""
PROTOTYPES = """protos AS (SELECT row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS idx, z AS vec FROM z ORDER BY md5('7:' || id), id LIMIT 3),
routed AS (SELECT z.id, arg_max(idx, {'s': round(list_inner_product(z, vec), 12), 'i': -idx}) AS region FROM z, protos GROUP BY z.id)"""


def cache(spark: SparkSession, d: str) -> DataFrame:
    """Windows of four latents; a slot's copy in a later window differs by the window's own small shift."""
    lat = latents(spark, d)
    starts = lat.where("id % 25 <= 21").select(F.col("id").alias("start"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.col("id") + t)).alias("slot", "at"))
    rows = starts.join(lat.select(F.col("id").alias("at"), "latent"), "at").withColumn("v", F.transform("latent", lambda x: x + F.col("slot") * 1e-3))
    return rows.groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda x: x["v"]).alias("emb")).withColumn("act_emb", F.transform("emb", lambda v: F.slice(v, 1, 4)))


SLOTS = f"""{LATENTS}, starts AS (SELECT id AS start FROM lat WHERE id % 25 <= 21),
slots AS (SELECT start, slot, start + slot AS ts, list_transform(latent, lambda x: x + slot * 1e-3) AS latent FROM (SELECT start, unnest(range(0, 4)) AS slot FROM starts) w JOIN lat ON lat.id = w.start + w.slot)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Run results: each group of line items is a run."""
    l = table(spark, d, "lineitem")  # noqa: E741
    keys = [F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 3).alias("train_seed"), (F.col("l_partkey") % 4).alias("partition_seed"), (F.col("l_linenumber") % 5).cast("long").alias("eval_seed")]
    r = l.select(*keys, (F.col("l_discount") > 0.05).cast("double").alias("ok")).groupBy("method", "train_seed", "partition_seed", "eval_seed")
    return r.agg((100 * F.avg("ok")).alias("success_rate"), F.count("*").alias("num_eval")).withColumn("starts", F.array(F.col("eval_seed"), F.col("eval_seed") * 7 + 1))


RUNS = """runs AS (SELECT l_returnflag AS method, l_suppkey % 3 AS train_seed, l_partkey % 4 AS partition_seed, (l_linenumber % 5)::BIGINT AS eval_seed,
  100 * avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0 END) AS success_rate, count(*) AS num_eval FROM lineitem GROUP BY 1, 2, 3, 4)"""


def losses(spark: SparkSession, d: str) -> DataFrame:
    """Long loss rows: an order line is an anchor, its supplier's number modulo 3 the region, four models score it."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.max("l_tax").alias("tax"), F.max("l_discount").alias("disc"))  # noqa: E741
    base = l.select((F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_suppkey")).alias("start"), (F.col("l_suppkey") % 3).alias("region"), (F.col("l_suppkey") % 40).alias("episode"), F.pmod(F.col("l_orderkey"), F.lit(3)).alias("seed"), "tax", "disc")
    at = base.withColumn("model", F.explode(F.array(*[F.lit(m).cast("long") for m in (-1, 0, 1, 2)])))
    loss = F.when(F.col("model") == -1, F.col("tax") + F.col("disc") + 0.5).when(F.col("model") == F.col("region"), F.col("tax") + 0.25).otherwise(F.col("tax") + F.col("disc") * (F.col("model") + 1) + 0.75)
    return at.select("start", "region", "episode", "seed", "model", loss.alias("loss"))


LOSSES = """base AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey AS start, l_suppkey % 3 AS region, l_suppkey % 40 AS episode, l_orderkey % 3 AS seed, max(l_tax) AS tax, max(l_discount) AS disc
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey),
losses AS (SELECT start, region, episode, seed, model, CASE WHEN model = -1 THEN tax + disc + 0.5 WHEN model = region THEN tax + 0.25 ELSE tax + disc * (model + 1) + 0.75 END AS loss FROM (SELECT *, unnest([-1, 0, 1, 2]) AS model FROM base)),
samples AS (SELECT seed, episode, start, region, avg(loss) FILTER (WHERE model = -1) AS global_mse, avg(loss) FILTER (WHERE model = region) AS correct_mse,
  avg(loss) FILTER (WHERE model <> region AND model <> -1) AS wrong_mean_mse, min(loss) FILTER (WHERE model <> region AND model <> -1) AS wrong_best_mse FROM losses GROUP BY 1, 2, 3, 4)"""


def labelings(spark: SparkSession, d: str) -> DataFrame:
    """Runs (seed, id, label) of clusterings of the latents: the true label, moved for some rows of each seed."""
    lat = latents(spark, d).select("id", "label").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in range(4)])))
    moved = F.pmod(F.col("id") * 31 + F.col("seed") * 17, F.lit(5 + 2 * 1)) < F.col("seed")
    return lat.select("seed", "id", F.when(moved, (F.col("label") + F.col("id")) % 4).otherwise(F.col("label") % 4).alias("label"))


LABELINGS = """labelings AS (SELECT seed, vec_id AS id, CASE WHEN (vec_id * 31 + seed * 17) % 7 < seed THEN (label + vec_id) % 4 ELSE label % 4 END AS label FROM (SELECT vec_id, label::BIGINT AS label, unnest(range(0, 4)) AS seed FROM embeddings))"""


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions on the square of the geometric regions, from line items."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_discount", "l_tax", (F.col("l_quantity") * 4.4).alias("x"), (F.col("l_extendedprice") % 224).alias("y"), (F.col("l_suppkey") % 2 == 0).alias("ref"))


POSITIONS = "pos AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey, l_discount, l_tax, l_quantity * 4.4 AS x, l_extendedprice % 224 AS y, l_suppkey % 2 = 0 AS ref FROM lineitem)"
