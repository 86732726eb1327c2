"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node parts its points by a plane
between two means that start from random points.  Every vector is routed to a
leaf of each tree.  A query walks all trees through one priority queue, ordered
by the least margin on the way.  It first opens a bounded number of rows; the
distance of the k-th nearest among them then says how far on it walks: leaves
behind a margin that is large against that distance hardly hold anything
nearer.  Vectors in clusters open few rows that way, whatever their number;
vectors without any structure open many, as they must for the same recall.
Candidates are reranked by the exact inner product.

Largest inner products are nearest directions once a coordinate
sqrt(M^2 - |x|^2) is added to each vector (0 for queries), M the largest norm.

Leaves are dealt in cells of bounded size, so a crowded leaf is many tasks.
Equal vectors are one class in the index; a result needs its k + 1 smallest ids
at most, so nothing is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, groups, materialize, shuffle_partitions

#: Vectors that the planes are fitted on, and how many of them a leaf holds; both bound the forest.
SAMPLE, SAMPLE_LEAF = 32_768, 64
#: Index rows that a query opens before it knows a distance.
FIRST_ROWS = 1000
#: Index rows of a cell and of a bucket of cells of one tree.
CELL_ROWS, BUCKET_ROWS = 2048, 8192


class Forest:
    """Planes and children of all trees; nodes are numbered through, leaves have numbers of their own."""

    def __init__(self, points: np.ndarray, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[tuple[int, int]] = []  # a leaf is -1 - its number
        self.roots: list[int] = []
        self.tree_of_leaf: list[int] = []
        for t in range(trees):
            self.roots.append(self._build(points, np.arange(len(points)), rng, t))
        self.plane_matrix = np.array(self.planes).reshape(len(self.planes), points.shape[1])
        self.cut = np.array(self.cuts)

    def _build(self, points: np.ndarray, rows: np.ndarray, rng: np.random.Generator, tree: int) -> int:
        if len(rows) > SAMPLE_LEAF:
            a, b = points[rng.choice(rows, 2, replace=False)]
            for _ in range(6):
                side = points[rows] @ (a - b) > (a - b) @ (a + b) / 2
                if side.all() or not side.any():
                    break
                a, b = points[rows[side]].mean(axis=0), points[rows[~side]].mean(axis=0)
            plane = a - b
            norm = np.linalg.norm(plane)
            if norm > 0:
                plane = plane / norm
                at = points[rows] @ plane
                cut = float(np.median(at))
                side = at > cut
                if side.any() and not side.all():
                    me = len(self.planes)
                    self.planes.append(plane)
                    self.cuts.append(cut)
                    self.children.append((0, 0))
                    self.children[me] = (self._build(points, rows[side], rng, tree), self._build(points, rows[~side], rng, tree))
                    return me
        self.tree_of_leaf.append(tree)
        return -len(self.tree_of_leaf)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.plane_matrix.T - self.cut if len(self.planes) else np.zeros((len(x), 0))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        child = np.array(self.children).reshape(-1, 2)
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for at in range(0, len(x), 512):
            right = self.margins(x[at : at + 512]) <= 0
            for t, root in enumerate(self.roots):
                node = np.full(len(right), root)
                while (open_ := node >= 0).any():
                    r, n = np.flatnonzero(open_), node[open_]
                    node[open_] = child[n, right[r, n].astype(np.int64)]
                out[at : at + 512, t] = -1 - node
        return out

    def search(self, margins: np.ndarray, rows_in: np.ndarray, enough: int, reach: float | None = None) -> list[int]:
        """The leaves that one query opens, best margin first over all trees.

        Without ``reach``, until they hold ``enough`` rows; with it, those
        after these, up to that margin.
        """
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found, rows = [], 0
        while queue:
            worst, node = heapq.heappop(queue)
            if rows >= enough and (reach is None or worst > reach):
                break
            if node < 0:
                if reach is None or rows >= enough:
                    found.append(-1 - node)
                rows += rows_in[-1 - node]
                continue
            left, right = self.children[node]
            m = margins[node]
            heapq.heappush(queue, (max(worst, -m), left))
            heapq.heappush(queue, (max(worst, m), right))
        return found


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=kind) for x in column.to_pylist()]).astype(np.float64)


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0.0, most**2 - (x * x).sum(axis=1)))[:, None]), axis=1)


def _pack(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(v, dtype=kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "vec"])

    return run


def _assign(forest, kind: str, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = f.leaves(_lift(_matrix(batch.column(1), kind), most))
            trees = leaf.shape[1]
            at = np.repeat(np.arange(batch.num_rows), trees)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "id", "vec"])

    return run


def _cells(rows_in: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-rows_in // CELL_ROWS))


def _bucket(tree: np.ndarray, leaf: np.ndarray, sub: np.ndarray, per_tree: int) -> np.ndarray:
    return tree * per_tree + (leaf * 7919 + sub) % per_tree


def _deal_index(forest, rows_in: np.ndarray, per_tree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_of, cells = np.array(forest.value.tree_of_leaf), _cells(rows_in)
        for batch in batches:
            leaf, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sub = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cells[leaf]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(_bucket(tree_of[leaf], leaf, sub, per_tree)), pa.array(np.zeros(n, dtype=np.int64)), batch.column(1), batch.column(2), pa.array([x.tobytes() for x in (leaf << 24 | sub)[:, None]], pa.binary())],
                names=["bucket", "kind", "id", "vec", "cells"],
            )

    return run


def _deal_queries(forest, rows_in: np.ndarray, per_tree: int, kind: str):
    """Rows (id, vec, reach): a query goes to each bucket that holds cells it opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        tree_of, cells = np.array(f.tree_of_leaf), _cells(rows_in)
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                x = _matrix(batch.column(1), kind)
                margins, reach = f.margins(np.concatenate((x, np.zeros((len(x), 1))), axis=1)), batch.column(2).to_pylist()
                out: tuple[list, list, list] = ([], [], [])
                for row in range(len(x)):
                    leaf = np.array(f.search(margins[row], rows_in, FIRST_ROWS, reach[row]), dtype=np.int64)
                    if not len(leaf):
                        continue
                    sub = np.concatenate([np.arange(c) for c in cells[leaf]])
                    leaf = np.repeat(leaf, cells[leaf])
                    bucket = _bucket(tree_of[leaf], leaf, sub, per_tree)
                    order = np.argsort(bucket, kind="stable")
                    code, bucket = (leaf << 24 | sub)[order], bucket[order]
                    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=True):
                        out[0].append(row)
                        out[1].append(int(bucket[a]))
                        out[2].append(code[a:b].tobytes())
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[1], pa.int64()), pa.array(np.ones(len(at), dtype=np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(out[2], pa.binary())],
                    names=["bucket", "kind", "id", "vec", "cells"],
                )

    return run


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best rows of each query: score down, then id."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[nth < keep]


def _top(s: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` best of each row of scores; of equal scores at the edge those with the smallest ids."""
    if s.shape[1] <= n:
        return np.tile(np.arange(s.shape[1]), (len(s), 1))
    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
    edge = np.take_along_axis(s, top, axis=1).min(axis=1)
    for row in np.flatnonzero((s >= edge[:, None]).sum(axis=1) > n):
        tied = np.flatnonzero(s[row] >= edge[row])
        top[row] = tied[np.lexsort((ids[tied], -s[row, tied]))[:n]]
    return top


class _Bucket:
    """Index rows of a bucket by cell."""

    def __init__(self, parts: list[pa.RecordBatch], kind: str):
        table = pa.Table.from_batches(parts)
        code = np.frombuffer(b"".join(table.column("cells").to_pylist()), dtype=np.int64)
        order = np.argsort(code, kind="stable")
        self.x, self.ids, code = _matrix(table.column("vec").combine_chunks(), kind)[order], table.column("id").to_numpy()[order], code[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        self.spans = dict(zip(code[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=True), strict=True))

    def answer(self, part: pa.RecordBatch, kind: str, keep: int) -> pa.RecordBatch | None:
        qid, q = part.column(2).to_numpy(), _matrix(part.column(3), kind)
        asked: dict[int, list[int]] = {}
        for row, code in enumerate(part.column(4).to_pylist()):
            for c in np.frombuffer(code, dtype=np.int64).tolist():
                asked.setdefault(c, []).append(row)
        got: tuple[list, list, list] = ([], [], [])
        for c, rows in asked.items():
            if c not in self.spans:
                continue
            a, b = self.spans[c]
            s = q[rows] @ self.x[a:b].T
            top = _top(s, self.ids[a:b], keep)
            got[0].append(np.repeat(np.array(rows), top.shape[1]))
            got[1].append(self.ids[a:b][top].ravel())
            got[2].append(np.take_along_axis(s, top, axis=1).ravel())
        if not got[0]:
            return None
        row, cid, score = (np.concatenate(g) for g in got)
        best = _best(row, cid, score, keep)
        row, cid, score = row[best], cid[best], score[best]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(qid[row[first]]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (cid, score))], names=["qid", "cids", "scores"])


def _rerank(kind: str, keep: int):
    """Exact scores of the candidates in each bucket: its index rows come first and are held, its queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist() if len(key) else []
            for a, b in zip(first, [*first[1:], len(key)], strict=True):
                bucket, which = divmod(int(key[a]), 2)
                if bucket != at:
                    at, held, index = bucket, [], None
                if which == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if index is None and held:
                    index, held = _Bucket(held, kind), []
                for start in range(a, b if index else a, 1024):
                    found = index.answer(batch.slice(start, min(1024, b - start)), kind, keep)
                    if found is not None:
                        yield found

    return run


def _reach(k: int, reach: float, kind: str, most: float):
    """The margin up to which a query walks on: ``reach`` times the distance of its k-th nearest so far, in the lifted space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = (_matrix(batch.column(1), kind) ** 2).sum(axis=1)
            far = []
            for n2, ids, scores in zip(own.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = np.sort(np.frombuffer(scores, dtype=np.float64)) if scores else np.zeros(0)
                far.append(reach * np.sqrt(max(0.0, n2 + most**2 - 2 * s[-k])) if len(s) >= k else np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64())], names=["id", "vec", "reach"])

    return run


def _merge(keep: int, packed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "qid"):
            cid = np.frombuffer(b"".join(table.column("cids").to_pylist()), dtype=np.int64)
            score = np.frombuffer(b"".join(table.column("scores").to_pylist()), dtype=np.float64)
            order = np.lexsort((-score, cid))
            order = order[np.concatenate(([True], cid[order][1:] != cid[order][:-1]))]  # a candidate that more trees found
            order = order[_best(np.zeros(len(order), dtype=np.int64), cid[order], score[order], keep)]
            qid, cid, score = table.column("qid")[0].as_py(), cid[order], score[order]
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array([qid]), pa.array([cid.tobytes()], pa.binary()), pa.array([score.tobytes()], pa.binary())], names=["qid", "cids", "scores"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), qid)), pa.array(cid), pa.array(score)], names=["query_id", "cid", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, trees: int = 4, reach: float = 0.135, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k nearest found among all other rows.

    ``is_query`` is a condition on ``vectors``.  Nearest is the largest inner
    product in double precision, ties to the smaller id.  A query opens
    FIRST_ROWS index rows and then all leaves whose margin is at most ``reach``
    times the distance of its k-th nearest so far; higher finds more.  Vectors
    that are null, empty, zero, of another length than the commonest, or hold
    null or non-finite components take no part, nor do rows without an id.
    Rows that repeat an id are candidates of their own, though not for each
    other, and one query, that of the vector whose hash is least.  With fewer
    than k other rows all are returned; an empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    dtype = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if dtype == "float" else "<f8"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite).withColumn("norm2", norm2).where(F.col("norm2") > 0)
    dims = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out_schema)
    rows = rows.where(F.size(v) == dims["d"]).withColumn("h", F.xxhash64("v"))
    first = Window.partitionBy("h").orderBy("id")
    members = materialize(rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("h", "id", "nth", "norm2", F.when(F.col("nth") == 1, v).alias("v")))
    heads = members.where("nth = 1")
    classes = materialize(heads.select("id", "v").mapInArrow(_pack(kind), "id long, vec binary"))
    count, most2 = members.where("nth = 1").agg(F.count("*"), F.max("norm2")).first()
    most = float(np.sqrt(most2))
    sample = classes.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(SAMPLE).toArrow()
    forest_here = Forest(_lift(_matrix(sample.column(1).combine_chunks(), kind), most), trees, seed)
    forest = spark.sparkContext.broadcast(forest_here)  # at most 2 * SAMPLE / SAMPLE_LEAF planes a tree

    index = materialize(classes.mapInArrow(_assign(forest, kind, most), "leaf long, id long, vec binary"))
    rows_in = np.zeros(len(forest_here.tree_of_leaf), dtype=np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row per leaf
        rows_in[r["leaf"]] = r["count"]
    per_tree = max(1, -(-count // BUCKET_ROWS))
    n = shuffle_partitions(spark)
    asked = rows.where("is_query").groupBy("id").agg(F.min(F.struct("h", "v")).alias("x")).select("id", F.col("x.v").alias("v"))
    asked = materialize(asked.mapInArrow(_pack(kind), "id long, vec binary"))

    def look(queries: DataFrame) -> DataFrame:
        dealt = "bucket long, kind long, id long, vec binary, cells binary"
        both = index.mapInArrow(_deal_index(forest, rows_in, per_tree), dealt).unionByName(queries.mapInArrow(_deal_queries(forest, rows_in, per_tree, kind), dealt))
        return both.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_rerank(kind, k + 1), packed)

    packed = "qid long, cids binary, scores binary"
    near = look(asked.withColumn("reach", F.lit(None).cast("double")))
    near = materialize(near.repartition(n, "qid").sortWithinPartitions("qid").mapInArrow(_merge(k + 1, packed=True), packed))
    on = asked.join(near, asked.id == near.qid, "left").select("id", "vec", "cids", "scores").mapInArrow(_reach(k + 1, reach, kind, most), "id long, vec binary, reach double")
    found = near.unionByName(look(on))
    best = materialize(found.repartition(n, "qid").sortWithinPartitions("qid").mapInArrow(_merge(k + 1), "query_id long, cid long, score double"))
    discard(classes, index, asked, near)
    named = members.select("h", "id").join(heads.select("h", F.col("id").alias("cid")), "h").select("cid", F.col("id").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = best.join(named, "cid").where("vec_id <> query_id").withColumn("rank", place).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
