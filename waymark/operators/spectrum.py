"""Low spectra of many graphs at once, by distributed products of edges with a block of vectors.

The wanted eigenvectors are the largest of A = D^-1/2 W D^-1/2.  Vertices are
dealt to parts; a part is one row that holds its vertices, the edges that leave
them, and its rows of the block of vectors.  A product sends each part's partial
sums to the parts they belong to: one shuffle, of what the edges touch, and
nothing passes through the driver.  Products in a row are a Chebyshev polynomial
that shrinks the unwanted part [-1, a] of the spectrum; as many as send
JOB_BYTES are one Spark job, and the shuffle files of a job go when it ends, so
the disk holds a product or two whatever their number.
After each polynomial the block is turned to orthonormal Ritz vectors by its own
Gram matrices, the only thing that meets the driver (width x width numbers a
graph, summed on the way).

All spread graphs share the products and stop when the residual ||A v - l v|| of
every wanted pair is below the tolerance; that it isn't after many polynomials is
an error, never a result.  A spread graph of at least as many components as wanted
pairs needs no iteration: its largest value is 1, once for each component, with
vectors that are known.

Graphs small enough for one part, as those of landmark samples are, don't need
shuffles: each is solved by the same steps in a task of its own, all in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.common import discard, materialize, shuffles_removed, uniform
from waymark.operators.vectors import moments, project

#: Growth of a polynomial at 1, which bounds its degree: beyond it rounding hides the small directions of a block.
MOST_GROWTH, MOST_DEGREE = 1e6, 20
#: Bytes of a part's rows of the block, at most, and edges that make another task worth while.
PART_BYTES, PART_EDGES = 16 << 20, 50_000
#: Bytes that the products of one job send, unless one product sends more.
JOB_BYTES = 256 << 20
#: Edges of a graph that one task solves, at most, and edges of one step of a product.
WHOLE_EDGES, STEP_EDGES = 4_000_000, 65_536
#: A graph of so few vertices is solved as a dense matrix.
DENSE = 256
#: A part's rows of two blocks, or (with ``part`` as the receiver) what it sends.
STATE, SENT = "part int, x binary, kept binary", "part int, own boolean, at binary, x binary, kept binary"


def _names(spark: SparkSession, n: int) -> list[int]:
    """n numbers that repartition(n, column) deals to n different partitions; 0 to n - 1 would leave a third of them empty."""
    at = spark.range(40 * n + 100).select(F.col("id").cast("int").alias("name")).groupBy(F.pmod(F.hash("name"), F.lit(n)).alias("to")).agg(F.min("name").alias("name"))
    found = [r["name"] for r in at.collect()]  # n numbers
    return found + [-1 - x for x in range(n - len(found))]


def _parts(edges: DataFrame, width: int) -> tuple[DataFrame, int, int]:
    """(one row per part: graphs and ids of its vertices in order, and the edges that leave them, by receiving part and vertex; number of parts; products of one job)."""
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = materialize(edges.groupBy("g", "i").agg(F.sum("w").alias("d")))
    n, m = d.count(), edges.count()
    parts = max(-(-n * width * 8 // PART_BYTES), min(tasks, 1 + m // PART_EDGES))
    together = max(1, JOB_BYTES // ((min(m, n * parts) + 4 * n) * width * 8))  # partial sums, and both blocks on their way to a join and back
    place = F.row_number().over(Window.partitionBy("part").orderBy("g", "i")) - 1
    names = F.array(*map(F.lit, _names(edges.sparkSession, parts)))
    vertices = materialize(d.withColumn("part", F.element_at(names, 1 + F.pmod(F.xxhash64("g", "i"), F.lit(parts)).cast("int"))).withColumn("at", place))
    to = vertices.select("g", "i", F.col("d").alias("d_to"), F.col("part").alias("to"), F.col("at").alias("at_to"))
    out = edges.join(to, ["g", "i"]).join(vertices.select("g", F.col("i").alias("j"), "d", "part", "at"), ["g", "j"])
    out = out.select("part", "to", "at_to", "at", (F.col("w") / F.sqrt(F.col("d") * F.col("d_to"))).alias("w"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["to", "at_to", "at"])
        row = {c: [pdf[c].to_numpy().astype(t).tobytes()] for c, t in (("to", "<i4"), ("at_to", "<i4"), ("at", "<i4"), ("w", "<f8"))}
        return pd.DataFrame({"part": [key[0]], **row})

    packed = out.groupBy("part").applyInPandas(pack, "part int, to binary, at_to binary, at binary, w binary")
    named = vertices.groupBy("part").applyInPandas(lambda key, pdf: pd.DataFrame({"part": [key[0]], **{c: [pdf.sort_values("at")[c].to_numpy().astype("<i8").tobytes()] for c in ("g", "i")}}), "part int, g binary, i binary")
    table = materialize(named.join(packed, "part"))
    discard(d, vertices)
    return table.repartition(parts, "part").persist(), parts, together


def _rows(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(-1, width)


def _send(width: int, factor: float, interval: dict[int, tuple[float, float]] | None):
    """What each part sends for x -> factor * (A - centre) x / half - kept, or without an interval for A x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _rows(r["x"], width)
                if interval is None:
                    base, scaled = np.zeros_like(x), x
                else:
                    centre, half = np.array([interval[k] for k in np.frombuffer(r["g"], dtype="<i8").tolist()]).T[:, :, None]
                    scaled = factor / half * x
                    base = -centre * scaled - (_rows(r["kept"], width) if factor > 1 else 0)
                out = [(r["part"], True, b"", base.tobytes(), r["x"])]
                to, at_to, at = (np.frombuffer(r[c], dtype="<i4") for c in ("to", "at_to", "at"))
                moved = scaled[at] * np.frombuffer(r["w"], dtype="<f8")[:, None]
                first = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (at_to[1:] != at_to[:-1])))) if len(to) else np.zeros(0, dtype=np.int64)
                sums, to, at_to = np.add.reduceat(moved, first) if len(first) else moved, to[first], at_to[first]
                for part in np.unique(to).tolist():
                    a, b = np.searchsorted(to, [part, part + 1])
                    out.append((part, False, at_to[a:b].tobytes(), sums[a:b].tobytes(), b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "own", "at", "x", "kept"])

    return run


def _receive(width: int):
    """(part, sum of what came, the part's block before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[np.ndarray, bytes]] = {}
        early: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["own"]:
                    own[r["part"]] = (_rows(r["x"], width).copy(), r["kept"])
                else:
                    early.setdefault(r["part"], []).append((r["at"], r["x"]))
                    if r["part"] not in own:
                        continue
                for at, x in early.pop(r["part"], ()):
                    own[r["part"]][0][np.frombuffer(at, dtype="<i4")] += _rows(x, width)  # a sender names a vertex once
        for part, (x, kept) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([kept], pa.binary())], names=["part", "x", "kept"])

    return run


def _product(parts: DataFrame, count: int, block: DataFrame, width: int, factor: float = 1.0, interval: dict | None = None) -> DataFrame:
    met = parts.join(block.hint("merge"), "part").select("part", "g", "to", "at_to", "at", "w", "x", "kept")
    return met.mapInArrow(_send(width, factor, interval), SENT).repartition(count, "part").mapInArrow(_receive(width), STATE)


def _each_graph(g: np.ndarray) -> Iterator[tuple[int, slice]]:
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))).tolist()
    for a, b in zip(first, [*first[1:], len(g)], strict=True):
        yield int(g[a]), slice(a, b)


def _grams(parts: DataFrame, block: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Graph -> (y'y, y'z, z'z) with z = x and y = kept, summed over its vertices."""

    def add(batches: Iterator[pa.RecordBatch], of: Callable) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in (pair for r in batch.to_pylist() for pair in of(r)):
                total[k] = total.get(k, 0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["g", "x"])

    def of_part(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        z, y = _rows(r["x"], width), _rows(r["kept"], width)
        for k, at in _each_graph(np.frombuffer(r["g"], dtype="<i8")):
            yield k, np.stack([y[at].T @ y[at], y[at].T @ z[at], z[at].T @ z[at]])

    def of_sum(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        yield r["g"], np.frombuffer(r["x"], dtype="<f8")

    met = parts.join(block.hint("merge"), "part").select("g", "x", "kept")
    summed = met.mapInArrow(lambda b: add(b, of_part), "g long, x binary").repartition("g").mapInArrow(lambda b: add(b, of_sum), "g long, x binary")
    return {r["g"]: np.frombuffer(r["x"], dtype="<f8").reshape(3, width, width) for r in summed.collect()}  # a row per graph


def _ritz(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, turn, residuals), largest value first; the columns of y @ turn are orthonormal."""
    yy, yz, zz = grams
    scale = np.where(np.diag(yy) > 0, 1 / np.sqrt(np.maximum(np.diag(yy), 1e-300)), 0.0)
    size, axes = np.linalg.eigh(scale[:, None] * yy * scale)
    good = size > 1e-13 * max(size.max(), 1e-300)
    white = scale[:, None] * axes[:, good] / np.sqrt(size[good])
    small = white.T @ yz @ white
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], white @ vectors[:, ::-1]
    residual = np.sqrt(np.maximum(0.0, np.einsum("ij,ik,kj->j", turn, zz, turn) - values**2))
    return values, turn, residual


def _start(width: int, seed: int):
    """Numbers between -1 and 1 that hang on seed, graph and vertex only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g, i = (np.frombuffer(r[c], dtype="<u8") for c in ("g", "i"))
                h = (i * np.uint64(0x9E3779B97F4A7C15) + g * np.uint64(0xD1B54A32D192ED03))[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(seed)
                for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
                x = ((h ^ (h >> np.uint64(31))).astype(np.float64) / 2.0**63 - 1).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([x], pa.binary()), pa.array([b""], pa.binary())], names=["part", "x", "kept"])

    return run


def _turn(width: int, turns: dict[int, np.ndarray]):
    """y of each graph times its matrix, with zeros for columns that the graph doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                y = _rows(r["kept"], width)
                out = np.zeros_like(y)
                for k, at in _each_graph(np.frombuffer(r["g"], dtype="<i8")):
                    out[at, : turns[k].shape[1]] = y[at] @ turns[k]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([out.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["part", "x", "kept"])

    return run


def _vectors(width: int, count: int, turns: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                y, g = _rows(r["kept"], width), np.frombuffer(r["g"], dtype="<i8")
                out = np.zeros((len(y), count))
                for k, at in _each_graph(g):
                    out[at, : turns[k].shape[1]] = y[at] @ turns[k]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.frombuffer(r["i"], dtype="<i8")), pa.array(list(out), pa.list_(pa.float64()))], names=["g", "id", "x"])

    return run


def _next_interval(values: np.ndarray, residual: np.ndarray, count: int, tol: float) -> tuple[tuple[float, float], int]:
    """((centre, half) of what the next polynomial shrinks, its degree).

    A polynomial may grow a pair that has settled as it likes: the others hold
    next to nothing of it.
    """
    # the block's last values are still on their way up, so the cut stays below those of a short block
    half = (float(np.clip(values[-1] - (0.0 if len(values) > count else 0.1), -0.9, 0.9999)) + 1) / 2
    top = max((v for v, r in zip(values, residual, strict=True) if r > 1e-3), default=values[min(count, len(values)) - 1])
    at = (top - half + 1) / half
    degree = int(np.log(2 * MOST_GROWTH) / np.arccosh(at)) if at > 1 + 1e-9 else MOST_DEGREE
    return (half - 1, half), min(MOST_DEGREE, max(2, degree))


def _solve_whole(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, count: int, width: int, seed: int, tol: float, most: int, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of one graph in memory; edges are sorted by i."""
    d = np.bincount(i, weights=w, minlength=n)
    w = w / np.sqrt(d[i] * d[j])
    if n <= max(dense, width):
        a = np.zeros((n, n))
        np.add.at(a, (i, j), w)
        values, vectors = np.linalg.eigh((a + a.T) / 2)
        return values[::-1][:count], vectors[:, ::-1][:, :count]

    def apply(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for at in range(0, len(i), STEP_EDGES):
            k = slice(at, at + STEP_EDGES)
            first = np.flatnonzero(np.concatenate(([True], i[k][1:] != i[k][:-1])))
            out[i[k][first]] += np.add.reduceat(x[j[k]] * w[k][:, None], first)
        return out

    y = np.random.default_rng(seed).uniform(-1, 1, (n, width))
    (centre, half), degree, products = (-0.4, 0.6), 6, 0
    while True:
        before, y = y, (apply(y) - centre * y) / half
        for _ in range(degree - 1):
            before, y = y, 2 * (apply(y) - centre * y) / half - before
        z, products = apply(y), products + degree + 1
        values, turn, residual = _ritz(np.stack([y.T @ y, y.T @ z, z.T @ z]))
        y = y @ turn
        worst = residual[:count].max()
        if worst <= tol:
            return values[:count], y[:, :count]
        if products > most:
            raise RuntimeError(f"a residual is still {worst:.1e} after {products} products")
        (centre, half), degree = _next_interval(values, residual, count, tol)
        if y.shape[1] < width:  # directions that were lost come back as random ones
            y = np.concatenate((y, np.random.default_rng([seed, products]).uniform(-1, 1, (n, width - y.shape[1])) / np.sqrt(n)), axis=1)


def _whole(edges: DataFrame, count: int, width: int, seed: int, tol: float, most: int) -> DataFrame:
    """(g, id, x), and the values of a graph as the row without an id."""
    dense = DENSE

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["i"].to_numpy(), pdf["j"].to_numpy())))
        i, j, w = np.searchsorted(ids, pdf["i"].to_numpy()), np.searchsorted(ids, pdf["j"].to_numpy()), pdf["w"].to_numpy()
        order = np.lexsort((j, i))
        values, vectors = _solve_whole(len(ids), i[order], j[order], w[order], count, width, seed, tol, most, dense)
        rows = np.zeros((len(ids), count))
        rows[:, : len(values)] = vectors
        return pd.DataFrame({"g": key[0], "id": pd.array([*ids, None], dtype="Int64"), "x": [*rows, values]})

    return edges.groupBy("g").applyInPandas(solve, "g long, id long, x array<double>")


def _of_components(edges: DataFrame, g: int, count: int, seed: int) -> DataFrame | None:
    """As :func:`_whole` for a graph of at least ``count`` components, else None: the roots of the degrees of each component span the space of value 1."""
    from waymark.operators.graph import components

    d = materialize(edges.groupBy(F.col("i").alias("v")).agg(F.sum("w").alias("d")))
    try:
        labels = components(edges.where("w > 0"), d.select("v"))
    except RuntimeError:  # very long paths; the iteration does without
        return None
    total = materialize(d.join(labels, "v").groupBy("c").agg(F.sum("d").alias("total")))
    if total.count() < count:
        return None
    # a drawn basis of the space, as an iteration would end in
    drawn = materialize(total.withColumn("r", F.array(*[2 * uniform(seed * 1000 + t, "c") - 1 for t in range(count)])))
    size, axes = np.linalg.eigh(moments(drawn, ["r"])[2])
    per = project(drawn, np.zeros(count), axes / np.sqrt(size), "r", "x").select("c", "total", "x")
    own = d.join(labels, "v").join(per, "c").withColumn("s", F.sqrt(F.col("d") / F.greatest("total", F.lit(1e-300))))
    vectors = own.select(F.lit(g).cast("long").alias("g"), F.col("v").alias("id"), F.transform("x", lambda x: x * F.col("s")).alias("x"))
    return materialize(vectors.unionByName(edges.sparkSession.createDataFrame([(g, None, [1.0] * count)], vectors.schema)))


def _spread(edges: DataFrame, count: int, width: int, seed: int, tol: float, most: int) -> DataFrame:
    """As :func:`_whole`, by distributed products that all graphs share."""
    graphs, known = [r["g"] for r in edges.select("g").distinct().collect()], None  # large ones
    for g in list(graphs):
        one = _of_components(edges.where(F.col("g") == g).drop("g"), g, count, seed)
        if one is not None:
            known = one if known is None else known.unionByName(one)
            graphs.remove(g)
    if not graphs:
        return known
    found = _iterated(edges.where(F.col("g").isin(graphs)), graphs, count, width, seed, tol, most)
    return found if known is None else found.unionByName(known)


def _iterated(edges: DataFrame, graphs: list[int], count: int, width: int, seed: int, tol: float, most: int) -> DataFrame:
    parts, n, together = _parts(edges, width)
    block = parts.mapInArrow(_start(width, seed), STATE)
    interval, degree, products, old = dict.fromkeys(graphs, (-0.4, 0.6)), 6, 0, None

    def settled(block: DataFrame) -> DataFrame:
        """The block written; the one it was made from isn't read again."""
        nonlocal old
        new = materialize(block)
        if old is not None:
            discard(old)
        old = new
        return new

    try:
        while True:
            for step in range(degree):
                block = _product(parts, n, block, width, 2.0 if step else 1.0, interval)
                if (step + 1) % together == 0:
                    block = settled(block)
            new, products = settled(_product(parts, n, block, width)), products + degree + 1
            found = {g: _ritz(x) for g, x in _grams(parts, new, width).items()}
            open_ = {g: f for g, f in found.items() if f[2][:count].max() > tol}
            if not open_:
                turns = {g: t[:, :count] for g, (_, t, _) in found.items()}
                met = parts.join(new.hint("merge"), "part").select("g", "i", "kept")
                vectors = met.mapInArrow(_vectors(width, count, turns), "g long, id long, x array<double>")
                values = edges.sparkSession.createDataFrame([(g, None, v[:count].tolist()) for g, (v, _, _) in found.items()], vectors.schema)
                return materialize(vectors.unionByName(values))
            if products > most:
                raise RuntimeError(f"a residual is still {max(f[2][:count].max() for f in open_.values()):.1e} after {products} products")
            degree = MOST_DEGREE
            for g, (values, _, residual) in open_.items():
                interval[g], wanted = _next_interval(values, residual, count, tol)
                degree = min(degree, wanted)
            block = parts.join(new.hint("merge"), "part").select("part", "g", "kept").mapInArrow(_turn(width, {g: t for g, (_, t, _) in found.items()}), STATE)
    finally:
        if old is not None:
            discard(old)
        parts.unpersist()


def low_eigenpairs(edges: DataFrame, count: int, seed: int = 0, tol: float = 1e-5, extra: int = 30, most_products: int = 2000) -> tuple[DataFrame, DataFrame]:
    """((g, id, x), (g, values)): the ``count`` largest eigenpairs of D^-1/2 W D^-1/2 of every graph g.

    ``edges`` are (g, i, j, w) in both directions, with longs for g, i and j.
    Values fall from 1; ``x`` has a vertex's place in each vector, zeros for
    pairs that a graph of fewer vertices doesn't have.  The error of a value is
    about the square of its residual.  A residual that stays above ``tol`` is
    an error.
    """
    with shuffles_removed(edges.sparkSession):
        found = _low_eigenpairs(edges, count, count + extra, seed, tol, most_products)
    return found.where(F.col("id").isNotNull()), found.where(F.col("id").isNull()).select("g", F.col("x").alias("values"))


def _low_eigenpairs(edges: DataFrame, count: int, width: int, seed: int, tol: float, most_products: int) -> DataFrame:
    edges = materialize(edges.select(*[F.col(c).cast("long").alias(c) for c in ("g", "i", "j")], F.col("w").cast("double").alias("w")))
    sizes = edges.groupBy("g", "i").count().groupBy("g").agg(F.count("*").alias("n"), F.sum("count").alias("m"))
    sizes = materialize(sizes.select("g", ((F.col("n") * width * 8 <= PART_BYTES) & (F.col("m") <= WHOLE_EDGES)).alias("whole")))
    found = _whole(edges.join(sizes.where("whole"), "g", "left_semi"), count, width, seed, tol, most_products)
    if sizes.where("NOT whole").limit(1).count():
        found = found.unionByName(_spread(edges.join(sizes.where("NOT whole"), "g", "left_semi"), count, width, seed, tol, most_products))
    found = materialize(found)
    discard(edges, sizes)
    return found


def spectra(edges: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(g, idx, eigenvalue): the ``count`` smallest eigenvalues of each graph's normalised Laplacian, ascending from idx 0."""
    values = low_eigenpairs(edges, count, seed)[1]
    return values.select("g", F.posexplode("values").alias("idx", "v")).select("g", "idx", F.greatest(F.lit(0.0), 1 - F.col("v")).alias("eigenvalue"))
