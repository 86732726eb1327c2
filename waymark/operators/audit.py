"""Audits and provenance."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.agreement import pairwise_stability


def audit_disjoint(train: DataFrame, held: DataFrame, required: bool = False) -> DataFrame:
    """One row of counts of (start, ep) tables, shared starts and episodes, and the first 20 shared episodes."""
    eps = train.select("ep").intersect(held.select("ep"))
    starts = train.select("start").intersect(held.select("start"))
    count = lambda df, n: df.agg(F.count("*").alias(n))
    first = eps.orderBy("ep").limit(20).agg(F.sort_array(F.collect_list("ep")).alias("first_shared"))
    out = count(train, "n_train").crossJoin(count(held, "n_eval")).crossJoin(count(eps, "shared_episodes")).crossJoin(count(starts, "shared_starts")).crossJoin(first)  # one row each
    if required and out.first()["shared_episodes"]:
        raise ValueError("train and evaluation share episodes")
    return out


def audit_train_only(train: DataFrame, held: DataFrame, nominal: DataFrame, hashes: tuple[str, str]) -> DataFrame:
    """Flags: no shared episode, equal hashes, training episodes inside the nominal train split, evaluation outside it."""
    none = lambda df: F.lit(df.limit(1).count() == 0)
    one = train.sparkSession.range(1)
    return one.select(
        none(train.select("ep").intersect(held.select("ep"))).alias("no_shared_episode"),
        F.lit(hashes[0] == hashes[1]).alias("same_hash"),
        none(train.join(nominal, "ep", "left_anti")).alias("train_inside"),
        none(held.join(nominal, "ep", "left_semi")).alias("eval_outside"),
    )


def audit_exact(ids: DataFrame, expected: DataFrame) -> DataFrame:
    """D3: positions (pos, id) at which two ordered lists differ; none means equal."""
    return ids.select("pos", F.col("id").alias("got")).join(expected.select("pos", F.col("id").alias("want")), "pos", "full_outer").where(~F.col("got").eqNullSafe(F.col("want")))


def compare_tables(a: DataFrame, b: DataFrame, key: str, value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row: rows, rows missing on a side, exact, mismatches, largest difference, allclose of array values."""
    both = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key, "full_outer")
    lone = F.col("va").isNull() | F.col("vb").isNull() | (F.size("va") != F.size("vb"))
    gap = F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    close = F.forall(F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(y.cast("double"))), lambda x: x)
    out = both.agg(F.count("*").alias("n"), F.count_if(lone).alias("n_unmatched"), F.count_if(~lone & (gap > 0)).alias("n_mismatch"), F.max(F.when(~lone, gap)).alias("max_abs"), F.count_if(~lone & ~close).alias("n_far"))
    return out.withColumns({"exact": (F.col("n_unmatched") == 0) & (F.col("n_mismatch") == 0), "allclose": (F.col("n_unmatched") == 0) & (F.col("n_far") == 0)})


def acceptance(flags: DataFrame, truncated: bool = False, smoke: bool = False) -> DataFrame:
    """(accepted, eligible, failed) from rows (name, ok): all flags hold; eligible only for whole, full runs."""
    out = flags.agg(F.bool_and("ok").alias("accepted"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failed"))
    return out.withColumn("eligible", F.col("accepted") & F.lit(not truncated and not smoke))


def finite_scan(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column the number of infinite, NaN and null values."""
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(F.abs(F.col(c)) == float("inf")).alias("n_inf"), F.count_if(F.isnan(c)).alias("n_nan"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in cols]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def verify_run(metrics: DataFrame, horizons: list[int], min_seeds: int = 3) -> DataFrame:
    """Flags of a result table (seed, horizon, terminal, mean_loss): no infinity, enough seeds, all horizons, h = 1 terminal equals mean."""
    one = F.abs(F.col("terminal") - F.col("mean_loss")) <= 1e-9
    return metrics.agg(
        (F.count_if((F.abs(F.col("terminal")) == float("inf")) | (F.abs(F.col("mean_loss")) == float("inf"))) == 0).alias("finite"),
        (F.countDistinct("seed") >= min_seeds).alias("enough_seeds"),
        (F.countDistinct(F.when(F.col("horizon").isin(horizons), F.col("horizon"))) == len(set(horizons))).alias("all_horizons"),
        F.coalesce(F.bool_and(F.when(F.col("horizon") == 1, one)), F.lit(False)).alias("one_step_agrees"),
    )


#: Rows of an ordered hash.
ORDERED_MOST = 1_000_000


def _text(df: DataFrame, name: str, places: int) -> Column:
    """A value as text that other engines write alike, with its length before it; null is told from every text."""
    kind, c = df.schema[name].dataType.typeName(), F.col(f"`{name}`")
    if kind in ("float", "double"):
        # beyond 2^53 units of the last place a double is its own integer part; NaN and infinities keep their names
        units = F.floor(c.cast("double") * F.lit(float(10**places)) + 0.5)
        text = F.when(F.abs(c) < F.lit(2.0**53 / 10**places), units.cast("string")).otherwise(c.cast("string"))
    elif kind in ("array", "map", "struct"):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.char_length(text).cast("string"), F.lit(":"), text))


def table_hash(df: DataFrame, places: int = 9) -> DataFrame:
    """(n, high, low): the sums of both halves of the rows' md5, modulo 2^64, whatever the order or partitioning.

    Columns count in order of their names.  Fractions count to ``places``
    decimals.  Any engine with md5 can form the same sums.
    """
    md5 = F.md5(F.concat(*[_text(df, c, places) for c in sorted(df.columns)]).cast("binary"))
    half = lambda at: F.conv(F.substring(md5, at, 16), 16, 10).cast("decimal(38,0)")
    whole = lambda name: (F.coalesce(F.sum(name), F.lit("0").cast("decimal(38,0)")) % F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("string").alias(name)
    return df.select(half(1).alias("high"), half(17).alias("low")).agg(F.count("*").alias("n"), whole("high"), whole("low"))


def ordered_hash(df: DataFrame, col: str, order: str) -> DataFrame:
    """sha256 of a small column in order, joined by commas; more than ORDERED_MOST rows are an error, as one task holds them."""
    if df.limit(ORDERED_MOST + 1).count() > ORDERED_MOST:
        raise ValueError(f"more than {ORDERED_MOST} rows: use table_hash")
    return df.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(col).cast("string").alias("_v")))), lambda x: x["_v"]), ","), 256).alias("sha256"))


def config_hash(config: dict) -> str:
    """sha256 of canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_manifest(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Fields (key, value) that are present and differ from what is expected; none means compatible."""
    return manifest.select("key", F.col("value").alias("got")).join(expected.select("key", F.col("value").alias("want")), "key").where(F.col("got").isNotNull() & (F.col("got") != F.col("want")))


def verify_gate(manifest: DataFrame, min_s: float = 0.5) -> DataFrame:
    """Whether recorded s, r, t_bg and graph counts of (task, e, t, s, r, t_bg, choice, n_graphs, want_graphs) imply the recorded choice."""
    implied = F.when((F.col("s") >= min_s) & (F.col("r") > F.col("t_bg")) & (F.col("r") > 0), "spectral").otherwise("global")
    sound = (F.abs(F.col("r") - (F.col("e") - F.col("t"))) < 1e-9) & (F.abs(F.col("s") - (1 - F.col("t") / F.col("e"))) < 1e-9)
    return manifest.select("task", (implied == F.col("choice")).alias("choice_implied"), sound.alias("numbers_agree"), (F.col("n_graphs") == F.col("want_graphs")).alias("all_graphs"))


def replay_audit(cache: DataFrame, recomputed: DataFrame, rtol: float = 1e-5) -> DataFrame:
    """D4 between stored and recomputed vectors (key, vec) of a sample."""
    return compare_tables(cache.join(recomputed.select("key"), "key", "left_semi"), recomputed, "key", "vec", rtol)


def dedup_stats(inverse: DataFrame) -> DataFrame:
    """Slots, distinct keys and what sharing saved, from (start, slot, key)."""
    out = inverse.agg(F.count("*").alias("n_slots"), F.countDistinct("key").alias("n_keys"), F.countDistinct("start").alias("n_windows"))
    return out.withColumns({"saved_share": 1 - F.col("n_keys") / F.col("n_slots"), "reuse": F.col("n_slots") / F.col("n_keys")})


def gate_summary(decisions: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Per task the decision with its numbers, and how many regions are empty or tiny (below max(1, 0.1 %))."""
    n = labels.groupBy("task", "region").agg(F.count("*").alias("n"))
    total = n.groupBy("task").agg(F.sum("n").alias("rows"), F.count("*").alias("used"))
    tiny = n.join(total, "task").groupBy("task").agg(F.count_if(F.col("n") < F.greatest(F.lit(1.0), 0.001 * F.col("rows"))).alias("n_tiny"), (F.lit(k) - F.max("used")).alias("n_empty"), F.max("rows").alias("rows"))
    return decisions.join(tiny, "task", "left")


def label_stability(runs: DataFrame) -> DataFrame:
    """Pairwise ARI and NMI of a task's labelings."""
    return pairwise_stability(runs)
