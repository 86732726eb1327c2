"""Mixing sources to target weights by cube-method balanced sampling.

A source's share of the mix over its size is its rate.  A row is taken
floor(rate) times for sure and once more with the fraction that is left, its
inclusion probability.  The flight phase moves the probabilities of three rows
at a time along the null space of the constraints (tokens and documents of the
source stay put) until one of them is 0 or 1.  Blocks of rows fly on their own,
so a hot source is many tasks; the at most two undecided rows a block leaves
fly again in coarser blocks, level by level, until one block a source is left.
Its last one or two rows are the landing problem, solved by enumeration.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NO_ID, WORD, discard, groups, materialize, shuffle_partitions

#: Rows of a block in the first level, and blocks that a block of the next level joins.
BLOCK_ROWS, FAN_IN = 512, 128
#: Up to this many sources are sent to every executor (about 60 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
_EPS = 1e-9


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, rank, source_size, n, target) from (source, source_size, n).

    Sources by code point, null last, have the weights in turn and share the
    sum of all sizes; a target stops at ``most`` times its source's size and
    the excess is reshared by weight.  With sources by rising cap over weight,
    the level of those that aren't capped is the highest level found when the
    sources before are taken as capped, so one running sum gives it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name).cast("long")).withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, all_rows = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    out = ranked.withColumn("level", level).withColumn("level", F.max("level").over(all_rows))
    return out.select("source", "rank", "source_size", "n", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _fly(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``pi`` until at most two rows are neither 0 nor 1."""
    pi = pi.tolist()
    x = size.tolist()
    held: list[int] = []
    draws = iter(())
    for i, p in enumerate(pi):
        if p <= _EPS or p >= 1 - _EPS:
            pi[i] = float(p >= 0.5)
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = [x[b] - x[c], x[c] - x[a], x[a] - x[b]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            ahead = min(((1 - pi[k]) / d if d > 0 else -pi[k] / d) for k, d in zip(held, u, strict=True) if d)
            back = min((pi[k] / d if d > 0 else (pi[k] - 1) / d) for k, d in zip(held, u, strict=True) if d)
            r = next(draws, None)
            if r is None:
                draws = iter(rng.random(256).tolist())
                r = next(draws)
            step = ahead if r * (ahead + back) < back else -back
            for k, d in zip(held, u, strict=True):
                pi[k] += step * d
                if pi[k] < _EPS or pi[k] > 1 - _EPS:
                    pi[k] = float(pi[k] > 0.5)
            held = [k for k in held if 0 < pi[k] < 1]
    return np.array(pi)


def _land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last rows so that the token total moves least, then the document total."""
    open_rows = np.flatnonzero((pi > 0) & (pi < 1))
    best = min(
        itertools.product((0.0, 1.0), repeat=len(open_rows)),
        key=lambda s: (abs(float(((np.array(s) - pi[open_rows]) * size[open_rows]).sum())), abs(float((np.array(s) - pi[open_rows]).sum()))),
    )
    pi = pi.copy()
    pi[open_rows] = best
    return pi


def _flight(seed: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "rank", "block"):
            rank, block = table.column("rank")[0].as_py(), table.column("block")[0].as_py()
            size = table.column("size").to_numpy().astype(np.float64)
            pi = _fly(table.column("pi").to_numpy(), size, np.random.default_rng([seed, level, rank, block]))
            if table.column("blocks")[0].as_py() == 1:
                pi = _land(pi, size)
            done = table.set_column(table.schema.get_field_index("pi"), "pi", pa.array(pi))
            yield from done.combine_chunks().to_batches()

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of ``docs``.

    ``size`` is the number of words of the text (null: 0) and ``copies`` how
    often the mix takes the row; never more than ``most`` rounded up, and a row
    that is taken at all is taken whole.  Reruns agree: blocks are dealt by a
    hash of doc_id and size and draws come from the block's own seed.  Null sources are
    one source, the last.  Rows without words are balanced as documents only.
    Repeated rows count separately and may get different copies.  An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")))
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    targets = materialize(source_targets(sizes, weights, most))
    top = targets.agg(F.max("n"), F.count("*")).first()
    small = F.broadcast(targets) if top[1] <= BROADCAST_SOURCES else targets
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    at = rows.join(small.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    at = at.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long")).withColumn("pi", F.col("rate") - F.floor("rate"))
    at = at.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
    at = at.withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks"))).drop("rate", "n")
    schema = at.schema
    blocks, level, open_rows, done = -(-(top[0] or 0) // BLOCK_ROWS), 0, at, []
    while True:
        dealt = open_rows.repartition(shuffle_partitions(spark), "rank", "block").sortWithinPartitions("rank", "block", "doc_id", "size")
        flown = materialize(dealt.mapInArrow(_flight(seed, level), schema))
        done.append(flown.where("pi = 0 OR pi = 1"))
        if blocks <= 1:
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
        open_rows = flown.where("pi > 0 AND pi < 1").withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("blocks", F.ceil(F.col("blocks") / FAN_IN))
        open_rows = open_rows.select([F.col(f.name).cast(f.dataType) for f in schema])
    discard(rows, sizes)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("pi").cast("long")).alias("copies"))


def take_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it.

    Rows that share doc_id, size and source are interchangeable, so they are
    matched by their number among each other; null ids are one id.  Rows that
    the mix doesn't know are left out; an empty table or mix gives no rows.
    Other columns stay as they are, whatever their names.
    """
    key = ["did", "name", "size"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    did, name = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("name")
    left = docs.select(did, name, word_count(F.col("text").cast("string")).alias("size"), F.struct(*docs.columns).alias("row")).withColumn("nth", nth)
    right = mix.select(did, name, "size", "copies").withColumn("nth", nth)
    # texts are dealt by id at every size: the mix has a row per document
    met = left.join(right.hint("merge"), [*key, "nth"])
    return met.where("copies > 0").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
