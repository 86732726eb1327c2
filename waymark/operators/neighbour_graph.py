"""An approximate neighbour graph by descent: neighbours of neighbours are likely neighbours.

Rows start with the best of a few small neighbourhoods, cut from the order of
random sign codes.  A round then brings together, at each row, a bounded sample
of its neighbours and of the rows that have it as a neighbour; pairs with at
least one new member are compared, and a pair goes on only if it improves one of
both lists.  Lists are merged by row; the descent stops when few entries change.

Nothing grows with the square of the table or of a row's fame: lists, samples
and neighbourhoods are of fixed size, and a row that very many others name takes
part with another sample each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.common import discard, materialize
from waymark.operators.vectors import l2_normalize

#: Rows of a first neighbourhood, and orders that they are cut from.
NEIGHBOURHOOD, ORDERS = 48, 3
LISTS = "id long, nbr long, sim double, fresh boolean"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.asarray(v, dtype="<f8").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype="<f8") for x in column.to_pylist()])


def _code(order: int, bits: int, seed: int):
    """(code, id, v): signs against random directions, the last direction's value as a tie-break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            at = x @ np.random.default_rng([seed, order]).normal(size=(x.shape[1], bits + 1))
            code = (at[:, :bits] > 0) @ (2.0 ** np.arange(bits)) + 0.5 + np.arctan(at[:, bits]) / np.pi
            yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(0), batch.column(1)], names=["code", "id", "v"])

    return run


def _best(row: np.ndarray, nbr: np.ndarray, sim: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best of each row, each neighbour once: similarity down, then id."""
    order = np.lexsort((nbr, row))
    order = order[np.concatenate(([True], (row[order][1:] != row[order][:-1]) | (nbr[order][1:] != nbr[order][:-1])))] if len(order) else order
    order = order[np.lexsort((nbr[order], -sim[order], row[order]))]
    r = row[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, dtype=np.int64)
    return order[np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) < keep]


def _neighbourhoods(keep: int):
    """The best of each row among the rows around it in the order of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held)
            n = table.num_rows if last else table.num_rows - NEIGHBOURHOOD
            parts = max(1, n // NEIGHBOURHOOD)
            edges = [n * p // parts for p in range(parts + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = table.slice(a, b - a)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks())
                s = np.round(x @ x.T, 12)
                i, j = np.nonzero(~np.eye(len(ids), dtype=bool) & (ids[:, None] != ids))
                at = _best(i, ids[j], s[i, j], keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[at]]), pa.array(ids[j[at]]), pa.array(s[i[at], j[at]]), pa.array(np.ones(len(at), dtype=bool))], names=["id", "nbr", "sim", "fresh"])
            held = table.slice(n).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > 4096:
                yield from flush(False)
        if held and sum(b.num_rows for b in held):
            yield from flush(True)

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cut = int(np.searchsorted(column, column[-1]))  # where the last group of the batch begins
        if cut or (held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != column[0]):
            done = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _merge(keep: int):
    """The best of old entries and improvements of each row; an entry is fresh if the row didn't have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "id"):
            row, nbr, sim, fresh = (t.column(c).to_numpy() for c in ("id", "nbr", "sim", "fresh"))
            order = np.argsort(fresh, kind="stable")  # an entry that was there stays the first of its kind
            row, nbr, sim, fresh = row[order], nbr[order], sim[order], fresh[order]
            at = _best(row, nbr, sim, keep)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (row, nbr, sim, fresh)], names=["id", "nbr", "sim", "fresh"])

    return run


def _compare(compared):
    """Pairs of the members met at a row that improve one of both; at least one of a pair is new there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "at"):
            at = t.column("at").to_numpy()
            ids, fresh, worst, x = t.column("nbr").to_numpy(), t.column("fresh").to_numpy(), t.column("worst").to_numpy(), _matrix(t.column("v").combine_chunks())
            edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                i, j = np.triu_indices(b - a, 1)
                some = fresh[a:b][i] | fresh[a:b][j]
                i, j = i[some] + a, j[some] + a
                compared.add(len(i))
                s = np.round(x[a:b] @ x[a:b].T, 12)[i - a, j - a]
                for p, q in ((i, j), (j, i)):
                    good = s > worst[p]
                    out[0].append(ids[p[good]])
                    out[1].append(ids[q[good]])
                    out[2].append(s[good])
            row, nbr, sim = (np.concatenate(o) for o in out)
            code = row != nbr
            row, nbr, sim = row[code], nbr[code], sim[code]
            first = np.unique(np.stack((row, nbr)), axis=1, return_index=True)[1] if len(row) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(nbr[first]), pa.array(sim[first]), pa.array(np.ones(len(first), dtype=bool))], names=["id", "nbr", "sim", "fresh"])

    return run


def descend(df: DataFrame, k: int, col: str = "latent", id_col: str = "id", size: int | None = None, rounds: int = 14, settled: float = 0.002, seed: int = 7) -> tuple[DataFrame, int]:
    """((id, nbr, sim, rank), pairs compared): up to ``k`` neighbours of each row by cosine, ties to the lower id.

    Lists hold ``size`` entries, four times ``k`` and at least 40 unless given;
    longer ones find more.  The descent stops when a round changes less than
    ``settled`` of all entries, or after ``rounds``.
    """
    spark = df.sparkSession
    size = size or max(4 * k, 40)
    sample = max(8, size // 2)
    rows = materialize(df.select(F.col(id_col).cast("long").alias("id"), l2_normalize(F.col(col)).alias("v")).mapInArrow(_pack, "id long, v binary"))
    count, tasks = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    compared, bits = spark.sparkContext.accumulator(ORDERS * count * NEIGHBOURHOOD // 2), max(1, int(np.log2(max(2, count / NEIGHBOURHOOD))))
    tasks = max(1, min(tasks, count // (4 * NEIGHBOURHOOD)))
    start = None
    for order in range(ORDERS):
        near = rows.mapInArrow(_code(order, bits, seed), "code double, id long, v binary").repartitionByRange(tasks, "code", "id").sortWithinPartitions("code", "id")
        found = near.mapInArrow(_neighbourhoods(size), LISTS)
        start = found if start is None else start.unionByName(found)

    def merged(entries: DataFrame) -> DataFrame:
        return materialize(entries.repartition(tasks, "id").sortWithinPartitions("id").mapInArrow(_merge(size), LISTS))

    lists = merged(start)
    for turn in range(rounds):
        both = lists.select(F.col("id").alias("at"), "nbr", "fresh").unionByName(lists.select(F.col("nbr").alias("at"), F.col("id").alias("nbr"), "fresh"))
        drawn = Window.partitionBy("at", "fresh").orderBy(F.xxhash64("at", "nbr", F.lit(seed * 100 + turn)))
        met = both.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= sample).groupBy("at", "nbr").agg(F.bool_or("fresh").alias("fresh"))
        worst = lists.groupBy("id").agg(F.when(F.count("*") >= size, F.min("sim")).otherwise(-2.0).alias("worst"))
        known = rows.join(worst, "id", "left").select(F.col("id").alias("nbr"), "v", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
        pairs = met.join(known, "nbr").repartition(tasks, "at").sortWithinPartitions("at", "nbr").mapInArrow(_compare(compared), LISTS)
        old, lists = lists, merged(lists.withColumn("fresh", F.lit(False)).unionByName(pairs))
        discard(old)
        changed = lists.where("fresh").count()
        if changed <= settled * count * size:
            break
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    out = materialize(lists.drop("fresh").withColumn("rank", rank).where(F.col("rank") <= k))
    discard(lists, rows)
    return out, compared.value
