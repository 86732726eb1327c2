"""Similarity graphs and their spectrum.

Graphs are edge tables (i, j, w); their spectra are found by distributed
products (:mod:`waymark.operators.spectrum`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.common import discard, materialize
from waymark.operators.neighbour_graph import descend
from waymark.operators.sampling import landmark_sample
from waymark.operators.spectrum import low_eigenpairs, spectra
from waymark.operators.vectors import l2_normalize

#: Vectors of one side of a block product (8 * D bytes each).
KNN_BLOCK = 2048
#: Rows of one group of an exact search (8 * D bytes each); a task holds two.
KNN_GROUP = 32_768


def _block_product(k: int):
    """The k best of each row of side 0 among side 1."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "nbr": [], "sim": []}).astype({"id": "int64", "nbr": "int64", "sim": "float64"})
        ids, nbr = a["id"].to_numpy(), b["id"].to_numpy()
        s = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        s[ids[:, None] == nbr[None, :]] = -np.inf
        s = np.round(s, 12)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        sim = np.take_along_axis(s, top, axis=1)
        out = pd.DataFrame({"id": np.repeat(ids, top.shape[1]), "nbr": nbr[top].ravel(), "sim": sim.ravel()})
        return out[np.isfinite(out.sim)]

    return product


def _by_row(col: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(row, kind="stable")
    return row[order], col[order]


def _raise(sim: np.ndarray, nbr: np.ndarray, rough: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
    """Merge products of x and y, known in single precision, into each row's best so far, sorted; ids rise and are above all seen before, so an equal one loses."""
    at, step, k = 0, 64 if sim[:, -1].min() == -np.inf else len(ids), sim.shape[1]
    slack = 1.2e-7 * (x.shape[1] + 16)  # twice what single precision can be off for unit vectors
    while at < len(ids):
        part = rough[:, at : at + step]
        some = part > (sim[:, -1:] - slack).astype(np.float32)  # what may be among the best
        row, col = np.nonzero(some) if some.flags.c_contiguous else _by_row(*np.nonzero(some.T))
        if 8 * len(row) > part.size:
            value = (x @ y[at : at + step].T)[row, col]
        else:
            value = np.einsum("ij,ij->i", x[row], y[at + col])
        value = np.round(value, 12)
        good = value > sim[row, -1]
        row, col, value = row[good], col[good], value[good]
        if len(row):
            rows, first, many = np.unique(row, return_index=True, return_counts=True)
            dense, names = np.full((len(rows), k + many.max()), -np.inf), np.zeros((len(rows), k + many.max()), dtype=np.int64)
            dense[:, :k], names[:, :k] = sim[rows], nbr[rows]
            place = np.repeat(np.arange(len(rows)), many), k + np.arange(len(row)) - np.repeat(first, many)
            dense[place], names[place] = value, ids[at + col]
            top = np.argsort(-dense, axis=1, kind="stable")[:, :k]
            sim[rows], nbr[rows] = np.take_along_axis(dense, top, axis=1), np.take_along_axis(names, top, axis=1)
        at, step = at + step, 4 * step


def _vectors_at(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """Rows of a column of vectors as a matrix, chunk by chunk: a second copy of the whole column would double a task's memory."""
    out, first = None, 0
    place = np.full(len(column), -1)
    place[at] = np.arange(len(at))
    for chunk in column.chunks:
        to = place[first : first + len(chunk)]
        first += len(chunk)
        if len(chunk):
            v = chunk.flatten().to_numpy().reshape(len(chunk), -1)
            out = np.empty((len(at), v.shape[1])) if out is None else out
            out[to[to >= 0]] = v[to >= 0]
    return np.zeros((0, 1)) if out is None else out


def _group_product(k: int):
    """The k best of each row of either group among the other's; of one group with itself, without the row."""

    def product(key: tuple, table: pa.Table) -> pa.Table:
        best, own = [], table.column("own").to_numpy()
        for side in (0,) if key[0].as_py() == key[1].as_py() else (0, 1):
            at = np.flatnonzero(own == side)
            at = at[np.argsort(table.column("id").to_numpy()[at], kind="stable")]
            best.append((table.column("id").to_numpy()[at], _vectors_at(table.column("v"), at), np.full((len(at), k), -np.inf), np.zeros((len(at), k), dtype=np.int64)))
        (ids, x, sim, nbr), (jds, y, mis, rbn) = best[0], best[-1]
        fx, fy = x.astype(np.float32), y.astype(np.float32)
        for a in range(0, len(ids), KNN_BLOCK) if len(jds) else ():
            i = slice(a, a + KNN_BLOCK)
            for b in range(a if len(best) == 1 else 0, len(jds), KNN_BLOCK):
                j = slice(b, b + KNN_BLOCK)
                s = fx[i] @ fy[j].T
                if len(best) == 1 and ids[i][-1] >= jds[j][0]:
                    s[ids[i][:, None] == jds[j][None, :]] = -np.inf
                if len(best) == 2 or a != b:
                    _raise(mis[j], rbn[j], s.T, y[j], x[i], ids[i])
                _raise(sim[i], nbr[i], s, x[i], y[j], jds[j])
        out = []
        for names, _, found, to in best:
            at, nth = np.nonzero(np.isfinite(found))
            out.append(pa.table({"id": names[at], "nbr": to[at, nth], "sim": found[at, nth]}))
        return pa.concat_tables(out)

    return product


def knn(df: DataFrame, k: int, col: str = "latent", id_col: str = "id") -> DataFrame:
    """G1: (id, nbr, sim, rank): the exact k nearest by cosine, self removed, ties to the lower id.

    The work grows with the square of the rows; memory doesn't.  Rows are dealt
    to groups of about KNN_GROUP by a hash of their id; each pair of groups is
    met once, block by block, for the rows of both, and only the k best per row
    and group go on.
    """
    n, tasks = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // KNN_GROUP), min(-(-n // KNN_BLOCK), math.ceil(math.sqrt(2 * tasks))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), l2_normalize(F.col(col)).alias("v")).withColumn("g", F.pmod(F.xxhash64(id_col), F.lit(groups)))
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = met.select(F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), "id", "v", (F.col("g") > F.col("o")).cast("int").alias("own"))
    found = met.groupBy("a", "b").applyInArrow(_group_product(k), "id long, nbr long, sim double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_approx(df: DataFrame, k: int, col: str = "latent", id_col: str = "id", size: int | None = None) -> DataFrame:
    """As :func:`knn`, by neighbour descent (:mod:`waymark.operators.neighbour_graph`): a bounded number of comparisons a row.

    A few neighbours may be missed; tests hold recall against :func:`knn`.  Rows
    whose list stays shorter than k are searched exactly, so every row gets k
    where the table has them.
    """
    found, _ = descend(df, k, col, id_col, size)
    full = found.where(F.col("rank") == k).select(F.col("id").alias("_full"))
    short = materialize(df.join(full, df[id_col] == F.col("_full"), "left_anti"))
    if not short.limit(1).count() or df.limit(k + 1).count() <= k:
        return found
    return found.join(short.select(F.col(id_col).alias("id")), "id", "left_anti").unionByName(_knn_of(short, df, k, col, id_col).select(found.columns))


def _knn_of(queries: DataFrame, df: DataFrame, k: int, col: str, id_col: str) -> DataFrame:
    """(id, nbr, sim, rank) of some rows among all: blocks of queries meet blocks of rows."""
    parts, rows_in = (max(1, -(-x.count() // KNN_BLOCK)) for x in (queries, df))
    unit = lambda x, n, name: x.select(F.col(id_col).alias("id"), l2_normalize(F.col(col)).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias(name))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = unit(queries, parts, "b").withColumn("o", span(rows_in)).select("b", "o", "id", "v", F.lit(0).alias("side"))
    right = unit(df, rows_in, "o").withColumn("b", span(parts)).select("b", "o", "id", "v", F.lit(1).alias("side"))
    found = left.unionByName(right).groupBy("b", "o").applyInPandas(_block_product(k), "id long, nbr long, sim double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def affinity_graphs(nearest: DataFrame) -> DataFrame:
    """G3 for many graphs: (g, i, j, w) from neighbours (g, id, nbr, sim), each graph with scales of its own."""
    e = nearest.select("g", F.col("id").alias("i"), F.col("nbr").alias("j"), F.greatest(F.lit(0.0), 2 - 2 * F.col("sim")).alias("d2"))
    sigma = e.groupBy("g", "i").agg(F.sqrt(F.max("d2")).alias("s"))
    floor = sigma.groupBy("g").agg(F.greatest(0.1 * F.percentile(F.when(F.col("s") > 0, F.col("s")), 0.01), F.lit(1e-4)).alias("f"))
    sigma = sigma.join(floor, "g").select("g", "i", F.greatest("s", F.coalesce("f", F.lit(1e-4))).alias("s"))
    w = e.join(sigma, ["g", "i"]).join(sigma.select("g", F.col("i").alias("j"), F.col("s").alias("t")), ["g", "j"])
    w = w.select("g", "i", "j", F.exp(-F.least(F.col("d2") / (F.col("s") * F.col("t")), F.lit(50.0))).alias("w"))
    return w.unionByName(w.select("g", F.col("j").alias("i"), F.col("i").alias("j"), "w")).where("i <> j").groupBy("g", "i", "j").agg(F.max("w").alias("w"))


def affinity_graph(nearest: DataFrame, k: int) -> DataFrame:
    """(i, j, w), symmetric by maximum, from the first k neighbours; each row's scale is its k-th distance."""
    return affinity_graphs(nearest.where(F.col("rank") <= k).withColumn("g", F.lit(0))).drop("g")


def components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(v, c): the least vertex each vertex reaches, by labels that spread along edges and jump over pointers."""
    ends = edges.select(F.col("i").alias("v")).union(edges.select("j"))
    if vertices is not None:
        ends = ends.union(vertices)
    both = materialize(edges.select("i", "j").union(edges.select("j", "i")).distinct())
    labels = materialize(ends.distinct().withColumn("c", F.col("v")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("v", "j"), "j").groupBy("i").agg(F.min("c").alias("near")).withColumnRenamed("i", "v")
        step = labels.join(near, "v", "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("near", "c")).alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("far"))
        new = materialize(step.join(jump, "c", "left").select("v", F.least("c", F.coalesce("far", "c")).alias("c"), "old"))
        labels = new.select("v", "c")
        if not new.where("c <> old").limit(1).count():
            return labels
    raise RuntimeError("labels didn't settle")


def component_summary(labels: DataFrame) -> DataFrame:
    """Size and share of each component."""
    sizes = labels.groupBy("c").agg(F.count("*").alias("n"))
    return sizes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Least, mean and largest degree and the number of vertices with none left."""
    d = edges.groupBy("i").agg(F.sum("w").alias("d"))
    return d.agg(F.min("d").alias("d_min"), F.avg("d").alias("d_mean"), F.max("d").alias("d_max"), F.count_if(F.col("d") <= 0).alias("n_zero"))


def laplacian_spectrum(edges: DataFrame, count: int, seed: int = 0) -> np.ndarray:
    """The smallest eigenvalues of the normalised Laplacian, ascending; an error if they don't settle."""
    return np.array([r["eigenvalue"] for r in spectra(edges.select(F.lit(0).alias("g"), "i", "j", "w"), count, seed).orderBy("idx").collect()])


def _nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, place) of the nearest of each set of centres [set, centre, dim]."""
    gap = (x * x).sum(axis=1)[:, None, None] + (centres * centres).sum(axis=2) - 2 * np.einsum("nd,skd->nsk", x, centres)
    at = np.round(gap, 12).argmin(axis=2)
    return np.maximum(0.0, np.take_along_axis(gap, at[:, :, None], axis=2)[:, :, 0]), at


def _plusplus(rows: DataFrame, k: int, seed: int, restarts: int) -> np.ndarray:
    """k-means++ centres [restart, centre, dim]: the row with the least -ln(u) / weight is a draw by weight; a pass serves all restarts."""
    centres = None
    for i in range(k):

        def least(batches: Iterator[pd.DataFrame], known: np.ndarray | None = centres, turn: int = i) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                x, ids = np.stack(pdf["x"].to_numpy()), pdf["id"].to_numpy()
                weight = np.ones((len(x), restarts)) if known is None else _nearest_centres(x, known)[0]
                u = np.stack([np.random.default_rng([seed, turn, int(j) & (2**63 - 1)]).random(restarts) for j in ids])
                key = -np.log1p(-u) / np.maximum(weight, 1e-300)
                for r in range(restarts):
                    at = np.lexsort((ids, key[:, r]))[0]
                    best[r] = min(best.get(r, (np.inf, 0, None)), (key[at, r], int(ids[at]), x[at]), key=lambda t: t[:2])
            yield pd.DataFrame([(r, *t) for r, t in best.items()], columns=["r", "key", "id", "x"])

        found = rows.mapInPandas(least, "r int, key double, id long, x array<double>").groupBy("r").agg(F.min(F.struct("key", "id", "x")).alias("m")).collect()  # a row per restart
        more = np.stack([r["m"]["x"] for r in sorted(found, key=lambda r: r["r"])])[:, None, :]
        centres = more if centres is None else np.concatenate((centres, more), axis=1)
    return centres


def _centre_sums(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """[set, centre, dim + 2]: sums of the rows nearest to each centre, their number and their cost; a partial row per task and centre."""
    sets, k, dim = centres.shape

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((sets, k, dim + 2))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            gap, at = _nearest_centres(x, centres)
            for r in range(sets):
                np.add.at(total[r], at[:, r], np.concatenate((x, np.ones((len(x), 1)), gap[:, r : r + 1]), axis=1))
        yield pd.DataFrame({"c": np.repeat(np.arange(sets * k), dim + 2), "d": np.tile(np.arange(dim + 2), sets * k), "x": total.ravel()})

    out = np.zeros((sets * k, dim + 2))
    got = rows.mapInPandas(part, "c int, d int, x double").groupBy("c", "d").agg(F.sum("x").alias("x")).toPandas()  # sets * k * dim rows
    out[got["c"].to_numpy(), got["d"].to_numpy()] = got["x"].to_numpy()
    return out.reshape(sets, k, dim + 2)


def spectral_labels(edges: DataFrame, k: int, seed: int = 0, restarts: int = 20, rounds: int = 100) -> DataFrame:
    """(id, region): the first k eigenvectors, rows L2-normalised, by the best of several k-means++ runs.

    Rows stay distributed: every pass serves all runs that still get better.
    """
    vectors, _ = low_eigenpairs(edges.select(F.lit(0).alias("g"), "i", "j", "w"), k, seed)
    rows = materialize(vectors.select("id", l2_normalize(F.col("x")).alias("x")))
    centres = _plusplus(rows, k, seed, restarts)
    cost, open_ = np.full(restarts, np.inf), np.arange(restarts)
    for _ in range(rounds):
        sums = _centre_sums(rows, centres[open_])
        now, count = sums[:, :, -1].sum(axis=1), sums[:, :, -2:-1]
        better = now < cost[open_] * (1 - 1e-9) - 1e-15
        cost[open_[better]] = now[better]
        moved = np.where(count > 0, sums[:, :, :-2] / np.maximum(count, 1), centres[open_])
        centres[open_[better]] = moved[better]
        open_ = open_[better]
        if not len(open_):
            break
    best = centres[[int(np.argmin(cost))]]
    discard(vectors)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "region": _nearest_centres(np.stack(pdf["x"].to_numpy()), best)[1][:, 0].astype(np.int32)})

    return rows.mapInPandas(label, "id long, region int")


def select_k(eigs: DataFrame, k_min: int, k_max: int) -> DataFrame:
    """(k, gap) of the largest step between neighbours of (idx from 0, eigenvalue); ties to the smaller k."""
    gap = F.col("eigenvalue") - F.lag("eigenvalue").over(Window.orderBy("idx"))  # a few dozen rows
    return eigs.withColumn("gap", gap).where(F.col("idx").between(k_min, k_max)).select(F.col("idx").alias("k"), "gap").orderBy(F.desc("gap"), "k").limit(1)


def ncut(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The normalised cut: the sum over regions of the share of volume that leaves the region."""
    a, b = labels.select(F.col("id").alias("i"), F.col("region").alias("ri")), labels.select(F.col("id").alias("j"), F.col("region").alias("rj"))
    per = edges.join(a, "i").join(b, "j").groupBy("ri").agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("ri") == F.col("rj"), F.col("w")).otherwise(0.0)).alias("inside"))
    return per.agg(F.sum((F.col("vol") - F.col("inside")) / F.greatest("vol", F.lit(1e-12))).alias("ncut"))


def relative_gaps(spectra: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(draw, knn, idx, gap) with gap = (next - own) / (next + eps)."""
    after = F.lead("eigenvalue").over(Window.partitionBy("draw", "knn").orderBy("idx"))
    return spectra.withColumn("gap", (after - F.col("eigenvalue")) / (after + eps)).where("gap IS NOT NULL").select("draw", "knn", "idx", "gap")


def scaled_mad(df: DataFrame, col: str) -> DataFrame:
    """One row (med, mad) with mad = 1.4826 * median absolute deviation."""
    med = df.agg(F.median(col).alias("med"))
    return df.crossJoin(F.broadcast(med)).agg(F.first("med").alias("med"), (1.4826 * F.median(F.abs(F.col(col) - F.col("med")))).alias("mad"))


#: Why the gate decides as it does; fixed values, in stored manifests too.
GATE_REASONS = ("candidate_gap_not_above_epsilon", "safety_and_background_checks_failed", "retained_safety_below_threshold", "residual_gap_not_above_background", "spectrally_nondegenerate")


def gate_faults(spectra: DataFrame, k: int, nominal_knn: int, background: int, draws: tuple | None = None, knns: tuple | None = None, least_draws: int = 3) -> list[str]:
    """Why spectra can't be judged: too few or other draws, graphs that a draw lacks, short or non-finite spectra.  One row a graph is looked at."""
    seen = spectra.groupBy("draw", "knn").agg(F.count("eigenvalue").alias("n"), F.count_if(F.isnan("eigenvalue") | (F.abs("eigenvalue") == float("inf"))).alias("bad"), F.countDistinct("idx").alias("places")).collect()
    told: dict[int, set] = {}
    for r in seen:
        told.setdefault(r["draw"], set()).add(r["knn"])
    every = set(knns) if knns else set().union(*told.values()) if told else set()
    faults = [f"{len(told)} draws, at least {least_draws} are needed"] if len(told) < least_draws else []
    if draws is not None and set(told) != set(draws):
        faults.append("the draws aren't those announced")
    if nominal_knn not in every or len(every) < 2:
        faults.append("the nominal graph and at least one other are needed")
    faults += [f"draw {d} lacks or adds graphs" for d, has in sorted(told.items()) if has != every]
    need = k + background + 1
    return faults + [f"draw {r['draw']}, {r['knn']} neighbours: {need} eigenvalues are needed" for r in seen if r["n"] < need or r["places"] != r["n"] or r["bad"]]


def gate_decision(spectra: DataFrame, k: int = 3, nominal_knn: int = 30, min_s: float = 0.5, background: int = 10, eps: float = 1e-8, draws: tuple | None = None, knns: tuple | None = None) -> DataFrame:
    """One row (e, t, s, r, t_bg, choice, reason) from (draw, knn, idx, eigenvalue).

    E is the least nominal gap after eigenvalue k, T twice its largest change
    with other neighbour counts, S = 1 - T / E and R = E - T (null if E isn't
    above ``eps``); the gap is real if S >= ``min_s`` and R exceeds every
    graph's background gap, median + 3 MAD.  Incomplete spectra are ValueErrors:
    fewer than three draws, a draw without one of the graphs, fewer than
    k + ``background`` + 1 eigenvalues.  The reasons are GATE_REASONS.
    """
    if faults := gate_faults(spectra, k, nominal_knn, background, draws, knns):
        raise ValueError("; ".join(faults))
    gaps = relative_gaps(spectra, eps)
    own = gaps.where(F.col("idx") == k - 1)
    nominal = own.where(F.col("knn") == nominal_knn).select("draw", F.col("gap").alias("base"))
    e = nominal.agg(F.min("base").alias("e"))
    t = own.join(nominal, "draw").agg((2 * F.max(F.abs(F.col("gap") - F.col("base")))).alias("t"))
    bg = gaps.where(F.col("idx").between(k, k + background - 1))
    med = bg.groupBy("draw", "knn").agg(F.median("gap").alias("med"))
    mad = bg.join(med, ["draw", "knn"]).groupBy("draw", "knn").agg((F.first("med") + 3 * 1.4826 * F.median(F.abs(F.col("gap") - F.col("med")))).alias("b"))
    one = e.crossJoin(t).crossJoin(mad.agg(F.max("b").alias("t_bg")))  # one row each
    real = F.col("e") > eps
    one = one.withColumn("r", F.when(real, F.col("e") - F.col("t"))).withColumn("s", F.when(real, 1 - F.col("t") / F.col("e")))
    safe, clear = F.col("s") >= min_s, F.col("r") > F.col("t_bg")
    no_gap, neither, unsafe, unclear, real_gap = GATE_REASONS
    reason: Column = F.when(~real, no_gap).when(safe & clear, real_gap).when(~safe & ~clear, neither).when(~safe, unsafe).otherwise(unclear)
    return one.withColumn("reason", reason).withColumn("choice", F.when(F.col("reason") == real_gap, "spectral").otherwise("global"))


def evaluate_gate(df: DataFrame, k: int = 3, seeds: tuple = (0, 1, 2), knns: tuple = (27, 30, 33), landmarks: int = 20_000, background: int = 10, group: str = "grp", col: str = "latent") -> tuple[DataFrame, DataFrame]:
    """(spectra, decision) over landmark draws and neighbour counts.

    One neighbour search per draw serves all its counts, and all graphs share
    the products of one eigenvalue run.  The middle count is the nominal one.
    """
    if len(set(seeds)) != len(seeds) or len(seeds) < 3 or len(set(knns)) != len(knns) or len(knns) < 2:
        raise ValueError("at least three draws and two neighbour counts, each once, are needed")
    graphs, near = [(draw, n) for draw in range(len(seeds)) for n in sorted(knns)], None
    for draw, seed in enumerate(seeds):
        own = knn(materialize(landmark_sample(df, landmarks, seed, group).drop("turn")), max(knns), col).withColumn("draw", F.lit(draw))
        near = own if near is None else near.unionByName(own)
    near = materialize(near)
    in_graphs = F.filter(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(draw).alias("draw"), F.lit(n).alias("n")) for g, (draw, n) in enumerate(graphs)]), lambda x: (x["draw"] == F.col("draw")) & (x["n"] >= F.col("rank")))
    edges = materialize(affinity_graphs(near.select("id", "nbr", "sim", F.explode(F.transform(in_graphs, lambda x: x["g"])).alias("g"))))
    named = df.sparkSession.createDataFrame([(g, draw, n) for g, (draw, n) in enumerate(graphs)], "g long, draw int, knn int")
    found = materialize(spectra(edges, k + background + 1, seeds[0])).join(F.broadcast(named), "g").select("draw", "knn", "idx", "eigenvalue")
    discard(near, edges)
    return found, gate_decision(found, k, sorted(knns)[len(knns) // 2], background=background, draws=tuple(range(len(seeds))), knns=tuple(knns))
