"""Trajectory windows and lookups.

Frames are rows (frame_id, ep, step, state, action); frame ids are contiguous
within an episode.  Windows are named by their first frame.

Spark takes exploded windows to be as small as the table they come from, so
their joins ask for a sort-merge join; a broadcast of them would fill the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.common import checked, global_rank, is_finite, seeded


def finite_rows(col: Column | str, array: bool = True) -> Column:
    """All elements (or the scalar) are finite; null is not."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.forall(c, is_finite) if array else is_finite(c), F.lit(False))


def valid_indices(frames: DataFrame, state: str = "state") -> DataFrame:
    """Ids of frames with a finite state."""
    return frames.where(F.col("frame_id").isNotNull() & finite_rows(state)).select("frame_id")


def valid_starts(frames: DataFrame, seq_len: int, stride: int = 1) -> DataFrame:
    """(start, ep): the frame (T-1)*stride later exists in the episode, and state and action are finite here.

    One window per episode, for episodes without missing steps; :func:`valid_starts_gaps` is for the others.
    """
    far = (seq_len - 1) * stride
    w = Window.partitionBy("ep").orderBy("step")
    if far == 0:
        return frames.where(finite_rows("state") & finite_rows("action")).select(F.col("frame_id").alias("start"), "ep")
    ahead = F.lead("frame_id", far).over(w)
    ok = (F.col("ahead") == F.col("frame_id") + far) & finite_rows("state") & finite_rows("action")
    return frames.withColumn("ahead", ahead).where(ok).select(F.col("frame_id").alias("start"), "ep")


def valid_starts_gaps(frames: DataFrame, seq_len: int, stride: int = 1) -> DataFrame:
    """T3 where steps may be missing: the later frame is looked up by id and episode."""
    far = (seq_len - 1) * stride
    later = frames.select((F.col("frame_id") - far).alias("frame_id"), F.col("ep").alias("far_ep"))
    met = frames.where(finite_rows("state") & finite_rows("action")).join(later, "frame_id")
    return met.where("ep = far_ep").select(F.col("frame_id").alias("start"), "ep")


def episode_table(frames: DataFrame) -> DataFrame:
    """(ep, off, len) of contiguous episodes."""
    return frames.groupBy("ep").agg(F.min("frame_id").alias("off"), F.count("*").alias("len"))


def episode_of(starts: DataFrame, episodes: DataFrame, bucket: int = 4096, start: str = "start") -> DataFrame:
    """T4: the episode whose range [off, off + len) holds the start.

    A range join as an equi join: an episode goes to each bucket of ids it
    touches, so neither side is broadcast and no pair outside a bucket is tried.
    """
    eps = episodes.withColumn("_b", F.explode(F.sequence(F.floor(F.col("off") / bucket), F.floor((F.col("off") + F.col("len") - 1) / bucket))))
    met = starts.withColumn("_b", F.floor(F.col(start) / bucket)).join(eps, "_b")
    return met.where((F.col(start) >= F.col("off")) & (F.col(start) < F.col("off") + F.col("len"))).drop("_b", "off", "len")


def episode_at(idx: DataFrame, frames: DataFrame) -> DataFrame:
    """T5: the episode column (episode_idx, else ep_idx, else ep) at row ids."""
    col = next(c for c in ("episode_idx", "ep_idx", "ep") if c in frames.columns)
    return idx.join(frames.select("frame_id", F.col(col).alias("episode")), "frame_id")


def expand_windows(starts: DataFrame, slots: int, frameskip: int = 1, limit: int | None = None) -> DataFrame:
    """(start, slot, frame_id) with frame_id = start + slot * frameskip; an id at or beyond ``limit`` is an error."""
    out = starts.select("start", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda t: F.col("start") + t * frameskip)).alias("slot", "frame_id"))
    if limit is not None:
        checked(out, out.where(F.col("frame_id") >= limit), "a window leaves the frame table")
    return out


def gather_sequences(windows: DataFrame, frames: DataFrame, col: str) -> DataFrame:
    """(start, seq): the column's values at a window's frames, in slot order."""
    met = windows.hint("merge").join(frames.select("frame_id", F.col(col).alias("_v")), "frame_id")
    return met.groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "_v"))), lambda x: x["_v"]).alias("seq"))


def gather_action_blocks(starts: DataFrame, frames: DataFrame, steps: int, frameskip: int) -> DataFrame:
    """(start, blocks): ``steps`` blocks of ``frameskip`` consecutive actions, each flattened in order."""
    seq = gather_sequences(expand_windows(starts, steps * frameskip, 1), frames, "action")
    seq = seq.where(F.size("seq") == steps * frameskip)
    return seq.select("start", F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.flatten(F.slice(F.col("seq"), k * frameskip + 1, frameskip))).alias("blocks"))


def action_stats(blocks: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(mean, scale) of finite blocks per dimension: population standard deviation plus eps."""
    flat = blocks.select(F.explode("blocks").alias("b")).where(finite_rows("b")).select(F.posexplode("b").alias("d", "x"))
    per = flat.groupBy("d").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + eps).alias("s"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("d", c))), lambda x: x[c])
    return per.agg(pick("m").alias("mean"), pick("s").alias("scale"))


def normalize_actions(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """(start, act): normalised blocks, padded with one zero block."""
    one = blocks.crossJoin(F.broadcast(stats))  # stats is one row
    normal = F.transform("blocks", lambda b: F.zip_with(F.zip_with(b, "mean", lambda x, m: x - m), "scale", lambda x, s: x / s))
    return one.select("start", F.concat(normal, F.array(F.transform(F.get("blocks", F.lit(0)), lambda _: F.lit(0.0)))).alias("act"))


def unique_frame_index(windows: DataFrame, slots: int | None = None, batch: int | None = None, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, inverse): the distinct frames of all slots, and each slot's key.

    With ``batch``, a frame is distinct for each batch shape it is encoded in:
    window ``ord`` i of ``total`` is in a batch of min(batch, total - floor(i / batch) * batch) windows.
    """
    shape = F.lit(0).cast("long") if batch is None else F.least(F.lit(batch), F.lit(total) - F.floor(F.col("ord") / batch) * batch).cast("long") * slots
    keyed = windows.withColumn("shape", shape)
    keys = global_rank(keyed.select("frame_id", "shape").distinct(), ["frame_id", "shape"], "key").withColumn("key", F.col("key") - 1)
    return keys, keyed.hint("merge").join(keys, ["frame_id", "shape"]).select("start", "slot", "key")


def reconstruct_windows(inverse: DataFrame, encoded: DataFrame) -> DataFrame:
    """(start, emb): each slot gets its key's vector, in slot order."""
    met = inverse.join(encoded.select("key", "vec"), "key")
    return met.groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "vec"))), lambda x: x["vec"]).alias("emb"))


def expand_latents(cache: DataFrame, frameskip: int = 1) -> DataFrame:
    """(start, slot, ts, latent), one row per window and slot."""
    rest = [c for c in ("shard",) if c in cache.columns]
    return cache.select("start", *rest, F.posexplode("emb").alias("slot", "latent")).withColumn("ts", F.col("start") + F.col("slot") * frameskip)


def dedup_timesteps(expanded: DataFrame) -> DataFrame:
    """The first slot of each timestep in flattened window order; a sum with map-side combining, not a sort."""
    order = F.struct(*[c for c in ("shard", "start", "slot") if c in expanded.columns])
    return expanded.groupBy("ts").agg(F.min_by("latent", order).alias("latent"), F.count("*").alias("copies"))


def lookup_first_shard(ids: DataFrame, shards: list[DataFrame]) -> DataFrame:
    """(id, vec) from the first shard that holds the id; an id in none is an error."""
    rows = reduce(DataFrame.unionByName, [s.select("id", "vec").withColumn("priority", F.lit(k)) for k, s in enumerate(shards)])
    found = rows.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("vec", "priority").alias("vec"), F.min("priority").alias("shard"))
    return checked(found, ids.join(found, "id", "left_anti"), "an id is in no shard")


def lookup_rows(ids: DataFrame, frames: DataFrame) -> DataFrame:
    """Requests (pos, frame_id) with their rows; duplicates and order (by pos) are kept, what is absent is null."""
    return ids.join(frames, "frame_id", "left")


def rollout_anchors(starts: DataFrame, horizon: int, frameskip: int = 1, history: int = 1) -> DataFrame:
    """Starts whose needed frames are all starts of the same episode; a horizon of 1 needs only the start."""
    if horizon == 1:
        return starts.select("start")
    needed = [k * frameskip for k in range(history)] + [(history - 1 + horizon) * frameskip]
    want = starts.select("start", F.col("ep").alias("own"), F.explode(F.array(*[F.lit(k).cast("long") for k in sorted(set(needed))])).alias("k"))
    met = want.join(starts.select(F.col("start").alias("at"), "ep"), F.col("start") + F.col("k") == F.col("at"))
    return met.where("ep = own").groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") == len(set(needed))).select("start")


def limit_anchors(anchors: DataFrame, max_rows: int | None = None, max_eps: int | None = None) -> DataFrame:
    """The first rows in order, cut before the first anchor of episode number max_eps + 1."""
    out = anchors
    if max_rows is not None:
        out = out.orderBy("start").limit(max_rows)
    if max_eps is not None:
        cut = out.groupBy("ep").agg(F.min("start").alias("first")).orderBy("first").limit(max_eps + 1).agg(F.max("first").alias("last"), F.count("*").alias("n"))
        out = out.crossJoin(F.broadcast(cut)).where((F.col("n") <= max_eps) | (F.col("start") < F.col("last"))).drop("last", "n")  # cut is one row
    return out


def eval_starts(frames: DataFrame, goal_offset: int, n: int = 0, seed: int = 0) -> DataFrame:
    """Frames that leave room for the goal, a seeded sample of n (all if n <= 0)."""
    last = F.max("step").over(Window.partitionBy("ep"))
    ok = frames.withColumn("_last", last).where(F.col("step") <= F.col("_last") + 1 - goal_offset - 1).select("frame_id", "ep", "step")
    return ok if n <= 0 else ok.orderBy(seeded(seed, "frame_id"), "frame_id").limit(n)


def index_by_start(cache: DataFrame) -> DataFrame:
    """One row per start; a repeated start is an error."""
    return checked(cache, cache.groupBy("start").count().where("count > 1"), "a start occurs twice")


def common_support(anchors: DataFrame, longest: int = 10) -> DataFrame:
    """Anchors (horizon, start) of every horizon that are valid at the longest one."""
    return anchors.join(anchors.where(F.col("horizon") == longest).select("start").distinct(), "start", "left_semi")


def subset(cache: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of given starts, all columns together."""
    return cache.join(ids.select("start").distinct(), "start", "left_semi")


def slice_starts(starts: DataFrame, offset: int, n: int) -> DataFrame:
    """A slice of the starts in order."""
    return starts.orderBy("start").offset(offset).limit(n)


def labelled_latents(cache: DataFrame, positions: DataFrame, label: Column, frameskip: int = 1) -> DataFrame:
    """(ts, latent, label): flatten, join positions by timestep, label by rule, drop what has none, keep first occurrences."""
    flat = expand_latents(cache, frameskip).join(positions, "ts").withColumn("label", label).where("label IS NOT NULL")
    order = F.struct(*[c for c in ("shard", "start", "slot") if c in flat.columns])
    return flat.groupBy("ts").agg(F.min_by("latent", order).alias("latent"), F.min_by("label", order).alias("label"))
