"""Seeded samples and splits (P1-P11).  Random orders are md5 keys, so every engine agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.common import global_rank, seeded


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """N rows without replacement, by id; all rows if n <= 0."""
    return df if n <= 0 else df.orderBy(seeded(seed, id_col), id_col).limit(n)


def _split(keys: DataFrame, key: str, fractions: list[tuple[str, float]], seed: int) -> DataFrame:
    """(key, split): keys in random order, cut at the half-even rounded fractions; the last split takes the rest."""
    ranked = global_rank(keys.select(key).distinct().withColumn("_k", seeded(seed, key)), ["_k", key], "_r").drop("_k")
    n = F.lit(ranked.count())
    upto, at, out = 0.0, [], None
    for name, f in fractions[:-1]:
        upto += f
        at.append((name, F.bround(n * F.lit(upto), 0)))
    for name, cut in at:
        out = F.when(F.col("_r") <= cut, name) if out is None else out.when(F.col("_r") <= cut, name)
    return ranked.select(key, out.otherwise(fractions[-1][0]).alias("split"))


def episode_split(starts: DataFrame, frac: float, seed: int) -> DataFrame:
    """Starts with split train or eval; episodes are never shared, and both sides have some."""
    eps = _split(starts, "ep", [("train", frac), ("eval", 1 - frac)], seed)
    if eps.select("split").distinct().count() != 2:
        raise ValueError("a side of the split is empty")
    return starts.join(eps, "ep")


def episode_split3(starts: DataFrame, fractions: dict[str, float], seed: int) -> DataFrame:
    """As P2 with three sides whose fractions sum to 1."""
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    return starts.join(_split(starts, "ep", list(fractions.items()), seed), "ep")


def transition_split(starts: DataFrame, frac: float, seed: int) -> DataFrame:
    """Starts themselves are split; sides may share episodes."""
    return starts.join(_split(starts, "start", [("train", frac), ("holdout", 1 - frac)], seed), "start")


def reference_iid_split(df: DataFrame, mask: str, frac: float, min_n: int, seed: int, id_col: str = "id", exclude: list[str] | None = None) -> DataFrame:
    """P5: mark the rows of ``mask`` as reference or iid, sizes clamped to ``min_n``; reference rows can leave other masks."""
    base = df.where(F.col(mask)).select(id_col)
    ranked = global_rank(base.withColumn("_k", seeded(seed, id_col)), ["_k", id_col], "_r").select(id_col, "_r")
    n = ranked.count()
    size = max(min(round(n * frac), n - min_n), min(min_n, n))
    out = df.join(ranked, id_col, "left")
    out = out.withColumns({"reference": F.coalesce(F.col("_r") <= size, F.lit(False)), "iid": F.coalesce(F.col("_r") > size, F.lit(False))}).drop("_r")
    return out.withColumns({m: F.col(m) & ~F.col("reference") for m in exclude or []})


def landmark_sample(df: DataFrame, n: int, seed: int, group: str, id_col: str = "id") -> DataFrame:
    """Every group's first pick before any second; random order within a round.

    A group needs at most n picks, which the ranking limit finds before the shuffle.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, id_col), id_col))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", seeded(seed, id_col), id_col).limit(n)


def balanced_sample(df: DataFrame, label: str, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """min(n, class size) rows of each class."""
    turn = F.row_number().over(Window.partitionBy(label).orderBy(seeded(seed, id_col), id_col))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= n).drop("_turn")


def group_holdout(df: DataFrame, group: str, label: str, frac: float, seed: int, tries: int = 50) -> DataFrame:
    """(group, holdout) of the first try whose two sides both have all labels; all tries in one pass over (group, label)."""
    seen = df.select(group, label).distinct()
    groups = seen.select(group).distinct()
    n = groups.count()
    size = max(1, round(n * frac))
    tried = groups.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    key = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("try")).cast("string"), F.col(group).cast("string")).cast("binary"))
    tried = tried.withColumn("holdout", F.row_number().over(Window.partitionBy("try").orderBy(key, group)) <= size)
    labels = seen.select(label).distinct().count()
    both = tried.join(seen, group).groupBy("try").agg(F.countDistinct(F.when(F.col("holdout"), F.col(label))).alias("h"), F.countDistinct(F.when(~F.col("holdout"), F.col(label))).alias("t"))
    first = both.where((F.col("h") == labels) & (F.col("t") == labels)).agg(F.min("try")).first()[0]
    if first is None:
        raise ValueError("no try covers all labels on both sides")
    return tried.where(F.col("try") == first).select(group, "holdout")


def holdout(df: DataFrame, frac: float, seed: int, key: str = "id") -> DataFrame:
    """max(1, floor(n * frac)) of the rows or groups named by ``key``."""
    ranked = global_rank(df.select(key).distinct().withColumn("_k", seeded(seed, key)), ["_k", key], "_r").select(key, "_r")
    size = max(1, int(ranked.count() * frac))
    return df.join(ranked.where(F.col("_r") <= size).select(key), key, "left_semi")


def split_manifest(split: DataFrame, caps: dict[str, int]) -> DataFrame:
    """P10: nominal and written counts of each side, and whether any is smaller than nominal."""
    cap = F.coalesce(*[F.when(F.col("split") == k, F.lit(v)) for k, v in caps.items()], F.lit(2**62))
    counts = split.groupBy("split").agg(F.count("*").alias("nominal")).withColumn("written", F.least("nominal", cap))
    return counts.withColumn("subsampled", F.max(F.col("written") < F.col("nominal")).over(Window.partitionBy()))


def starts_for_episodes(starts: DataFrame, eps: DataFrame) -> DataFrame:
    """The starts of given episodes."""
    return starts.join(eps.select("ep").distinct(), "ep", "left_semi")


