"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers, floor(scale * x).  A coordinate sqrt(M^2 - |x|^2) (0
for queries; M is the largest norm) makes large inner products small distances:
d^2 = |q|^2 + M^2 - 2 s.  A vector's key is its nearest pivot and the distance
to it.  In the order of keys the vectors are cut into annuli of one pivot each,
and neighbouring annuli into buckets, so a pivot that attracts many vectors is
many buckets.

A query first searches the bucket with the best bound, then every other bucket
whose bound reaches the (k + 1)-th best score so far.  In a bucket it expands
annuli from its own distance to their pivot outwards, and stops by the triangle
inequality: what lies in [lo, hi] around a pivot at distance D is at least
max(D - hi, lo - D) away, so its score has an upper bound.  Bounds only ever
leave out vectors that can't be in the result, so the result is exact.  How
many they leave out depends on the vectors: on points spread evenly in many
dimensions hardly any.

Pivots are fitted on a bounded sample and change cost only.  Equal vectors are
one class; a result needs its k + 1 smallest ids at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import _best, _top
from .shared import discard, groups, materialize, shuffle_partitions

#: Vectors that the pivots are fitted on, and the number of pivots.
SAMPLE, PIVOTS = 16_384, 128
#: Rows of an annulus, at least; with more than MOST_ANNULI * ANNULUS_ROWS vectors annuli are wider, so their table stays bounded.
ANNULUS_ROWS, MOST_ANNULI = 256, 65_536
#: Rows of a bucket, at most and at least; in between four buckets a task.
BUCKET_MOST, BUCKET_LEAST = 32_768, 1024
#: Bounds of a block of queries and all annuli that are held at once.
BOUNDS_AT_ONCE = 1 << 21
FOUND = "qid long, classes binary, ids binary, scores binary"
#: As one row: an annulus (classes and their least ids in ``ids``), or queries of one bucket (kind 1: ids and scores to reach).
PACKED = pa.schema([("bucket", pa.int64()), ("kind", pa.int64()), ("pivot", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary())])


class Pivots:
    """Pivots in the lifted space, and the distances of vectors and queries to them."""

    def __init__(self, points: np.ndarray, most2: int, seed: int):
        self.most2 = float(most2)
        lifted = self._lift(points)
        rng = np.random.default_rng(seed)
        at = lifted[np.sort(rng.choice(len(lifted), min(PIVOTS, max(1, len(lifted) // 16)), replace=False))]
        for _ in range(5):
            own = np.argmin(self._distances(lifted, at), axis=1)
            counts = np.bincount(own, minlength=len(at))
            sums = np.stack([np.bincount(own, weights=lifted[:, j], minlength=len(at)) for j in range(lifted.shape[1])], axis=1)
            at = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], at)
        self.at = at
        #: More than the error of a distance in double precision.
        self.slack = 1e-6 * (np.sqrt(self.most2) + 1)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(0.0, self.most2 - (x * x).sum(axis=1)))[:, None]), axis=1)

    @staticmethod
    def _distances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (at * at).sum(axis=1) - 2 * x @ at.T))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        return self._distances(self._lift(x), self.at)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._distances(np.concatenate((q, np.zeros((len(q), 1))), axis=1), self.at)

    def bounds(self, q: np.ndarray, away: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """No vector of an annulus scores more against a query than this: queries x annuli."""
        d = away[:, pivot]
        gap = np.maximum(0.0, np.maximum(d - hi, lo - d) - 2 * self.slack)
        total = (q * q).sum(axis=1)[:, None] + self.most2
        return (total - gap * gap) / 2 + 1e-6 * total + 1


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=kind) for x in column.to_pylist()]).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
    """Integer inner products; doubles hold them exactly unless ``wide``."""
    return q.astype(np.int64) @ x.astype(np.int64).T if wide else (q @ x.T).astype(np.int64)


def _quantise(scale: float, dim: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            out = np.zeros((batch.num_rows, dim), dtype=kind)
            out[np.arange(dim) < sizes[:, None]] = np.floor(scale * batch.column(1).flatten().to_numpy())
            rows = [row.tobytes() for row in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], names=["id", "vec", "is_query"])

    return run


def _key(pivots, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = pivots.value.of_vectors(_matrix(batch.column(2), kind))
            pivot = away.argmin(axis=1)
            keys = [pa.array(pivot), pa.array(away[np.arange(len(pivot)), pivot])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=["class", "id", "vec", "pivot", "dist"])

    return run


def _annuli(rows: int, bucket_rows: int):
    """One row per annulus, from rows in the order of their keys; buckets are numbered within the task's own range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        bucket, filled, held, held_pivot = 0, 0, [], None

        def annulus(parts: list) -> pa.RecordBatch:
            nonlocal bucket, filled
            t = pa.Table.from_batches(parts)
            if filled and filled + t.num_rows > bucket_rows:
                bucket, filled = bucket + 1, 0
            filled += t.num_rows
            dist = t.column("dist").to_numpy()
            ids, vecs = t.column("class").to_numpy().tobytes() + t.column("id").to_numpy().tobytes(), b"".join(t.column("vec").to_pylist())
            values = [base + bucket, 0, t.column("pivot")[0].as_py(), float(dist[0]), float(dist[-1]), t.num_rows, ids, vecs]
            return pa.RecordBatch.from_arrays([pa.array([v], type_) for v, type_ in zip(values, PACKED.types, strict=True)], names=PACKED.names)

        for batch in batches:
            pivot = batch.column(3).to_numpy()
            edges = np.flatnonzero(pivot[1:] != pivot[:-1]) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pivot)], strict=True):
                while a < b:
                    have = sum(p.num_rows for p in held)
                    if held and (held_pivot != pivot[a] or have >= rows):
                        yield annulus(held)
                        held, have = [], 0
                    held_pivot, take = pivot[a], min(b - a, rows - have)
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield annulus(held)

    return run


def _deal(pivots, table, kind: str, first: bool):
    """Rows (id, vec, at_least): each query goes to the bucket with the best bound, or to all others that reach ``at_least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (bucket, pivot, lo, hi) = pivots.value, table.value
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        step = max(1, BOUNDS_AT_ONCE // len(bucket))
        for whole in batches:
            out: dict[int, list[int]] = {}
            for at in range(0, whole.num_rows, step):
                q = _matrix(whole.column(1).slice(at, step), kind)
                away = p.of_queries(q)
                reach = np.maximum.reduceat(p.bounds(q, away, pivot, lo, hi), starts, axis=1)
                # of buckets that all may hold the best, the one with the nearest pivot comes first
                near = np.minimum.reduceat(away[:, pivot], starts, axis=1)
                best = np.argmin(np.where(reach >= reach.max(axis=1)[:, None], near, np.inf), axis=1)
                if first:
                    goes = zip(range(len(q)), best.tolist(), strict=True)
                else:
                    reach[np.arange(len(q)), best] = -np.inf
                    least = whole.column(2).slice(at, step).to_numpy(zero_copy_only=False)
                    goes = zip(*(x.tolist() for x in np.nonzero((reach >= least[:, None]) & (reach > -np.inf))), strict=True)
                for row, b in goes:
                    out.setdefault(b, []).append(at + row)
            for b, rows in out.items():
                for a in range(0, len(rows), 512):
                    part = whole.take(pa.array(rows[a : a + 512]))
                    head = part.column(0).to_numpy().tobytes() + part.column(2).to_numpy(zero_copy_only=False).tobytes()
                    values = [int(bucket[starts[b]]), 1, None, None, None, part.num_rows, head, b"".join(part.column(1).to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, PACKED.types, strict=True)], names=PACKED.names)

    return run


class _Bucket:
    """The annuli of one bucket."""

    def __init__(self, rows: list[dict], kind: str):
        self.pivot, self.lo, self.hi = (np.array([r[c] for r in rows]) for c in ("pivot", "lo", "hi"))
        self.classes, self.ids = zip(*(np.frombuffer(r["ids"], dtype=np.int64).reshape(2, -1) for r in rows), strict=True)
        self.x = [np.frombuffer(r["vecs"], dtype=kind).reshape(r["n"], -1).astype(np.float64) for r in rows]

    def search(self, p: Pivots, q: np.ndarray, least: np.ndarray, keep: int, wide: bool) -> tuple[np.ndarray, ...]:
        """(query, class, id, score) of the ``keep`` best of each query that reach what it has elsewhere."""
        bounds = p.bounds(q, p.of_queries(q), self.pivot, self.lo, self.hi)
        least = least.copy()
        found = (np.zeros(0, dtype=np.int64),) * 4
        for k in np.argsort(-bounds.mean(axis=0), kind="stable"):
            open_ = np.flatnonzero(bounds[:, k] >= least)
            if not len(open_):
                continue
            s = _scores(q[open_], self.x[k], wide)
            top = _top(s, self.ids[k], keep)
            new = (np.repeat(open_, top.shape[1]), self.classes[k][top].ravel(), self.ids[k][top].ravel(), np.take_along_axis(s, top, axis=1).ravel())
            good = new[3] >= least[new[0]]
            if not good.any():
                continue
            found = tuple(np.concatenate((a, b[good])) for a, b in zip(found, new, strict=True))
            best = _best(found[0], found[2], found[3], keep)
            row, _, _, score = found = tuple(a[best] for a in found)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            full = np.diff(np.append(first, len(row))) == keep
            last = (np.append(first[1:], len(row)) - 1)[full]
            least[row[last]] = np.maximum(least[row[last]], score[last])
        return found


def _packed(qid: np.ndarray, row: np.ndarray, *found: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    spans = list(zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(qid[row[first]]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in found)], names=["qid", "classes", "ids", "scores"])


def _search(pivots, kind: str, keep: int, wide: bool):
    """Rows of one bucket after another: its annuli come first and are held, its queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != at:
                    at, held, index = r["bucket"], [], None
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if index is None:
                    index, held = _Bucket(held, kind), []
                head = np.frombuffer(r["ids"], dtype=np.int64, count=r["n"])
                least = np.frombuffer(r["ids"], dtype=np.float64, offset=8 * r["n"])
                q = np.frombuffer(r["vecs"], dtype=kind).reshape(r["n"], -1).astype(np.float64)
                found = index.search(pivots.value, q, least, keep, wide)
                if len(found[0]):
                    yield _packed(head, *found)

    return run


def _merge(keep: int, packed: bool = False):
    """The ``keep`` best of each query: packed with the score that others have to reach, or one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "qid"):
            classes, ids, score = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int64) for c in ("classes", "ids", "scores"))
            best = _best(np.zeros(len(ids), dtype=np.int64), ids, score, keep)
            qid, classes, ids, score = table.column("qid")[0].as_py(), classes[best], ids[best], score[best]
            if packed:
                least = float(score[-1]) if len(score) == keep else -np.inf
                least -= abs(least) * 1e-15 if 2.0**53 < abs(least) < np.inf else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([qid]), *(pa.array([x.tobytes()], pa.binary()) for x in (classes, ids, score)), pa.array([least])], names=["qid", "classes", "ids", "scores", "at_least"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qid)), pa.array(classes), pa.array(score)], names=["query_id", "class", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, seed: int = 12, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best of all other rows, exactly.

    ``is_query`` is a condition on ``vectors``.  The score is the inner product
    of floor(``scale`` * x) as a 64-bit integer, ties to the smaller id; it is
    an error if scores may not fit.  Vectors that are null or hold null or
    non-finite components take no part, nor do rows without an id; zero vectors
    do; shorter vectors count as if zeros followed.  Rows that repeat an id are
    candidates of their own, though not for each other, and one query, that of
    the vector whose packed integers are least as bytes.  With fewer than k other rows all are returned; an empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v, out_schema = F.col("v"), "query_id long, rank int, vec_id long, score long"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.floor(x * F.lit(scale)).cast("double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(finite)
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + whole(x) * whole(x))
    largest = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    dim, most2, largest, queries = rows.agg(F.max(F.size("v")), F.max(norm2), F.max(largest), F.count_if("is_query")).first()
    if not queries:
        return spark.createDataFrame([], out_schema)
    if max(most2, largest * scale * largest * scale) >= 2.0**62:
        raise ValueError("scores may exceed 64 bits")
    dim, wide, kind = max(dim, 1), most2 >= 2.0**52, "<i2" if largest * scale < 2**15 - 2 else "<i8"
    keep, n = k + 1, shuffle_partitions(spark)

    made = materialize(rows.mapInArrow(_quantise(scale, dim, kind), "id long, vec binary, is_query boolean"))
    first = Window.partitionBy("vec").orderBy("id")
    members = made.select("vec", "id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= keep)
    number = F.min("place").over(Window.partitionBy("vec"))  # written at once, so it stays the class's number
    members = members.withColumn("place", F.monotonically_increasing_id()).withColumn("class", number)
    members = materialize(members.select("class", "id", F.when(F.col("nth") == 1, F.col("vec")).alias("vec")))
    heads = members.where(F.col("vec").isNotNull())
    sample = heads.select("id", "vec").orderBy(F.xxhash64("id", F.lit(seed)), "id", "vec").limit(SAMPLE).toArrow()
    pivots = spark.sparkContext.broadcast(Pivots(_matrix(sample.column(1).combine_chunks(), kind), most2, seed))  # PIVOTS vectors

    count = heads.count()
    bucket_rows = min(BUCKET_MOST, max(BUCKET_LEAST, count // (4 * n)))
    keyed = heads.mapInArrow(_key(pivots, kind), "class long, id long, vec binary, pivot long, dist double")
    ranged = keyed.repartitionByRange(n, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    annulus_rows = max(ANNULUS_ROWS, -(-count // MOST_ANNULI))
    packed = "bucket long, kind long, pivot long, lo double, hi double, n long, ids binary, vecs binary"
    index = materialize(ranged.mapInArrow(_annuli(annulus_rows, bucket_rows), packed))
    cells = index.select("bucket", "pivot", "lo", "hi").orderBy("bucket", "pivot", "lo").toArrow()  # at most about MOST_ANNULI + n * PIVOTS rows
    table = spark.sparkContext.broadcast(tuple(cells.column(c).to_numpy() for c in ("bucket", "pivot", "lo", "hi")))
    asked = made.where("is_query").groupBy("id").agg(F.min("vec").alias("vec"))
    asked = materialize(asked)

    def look(queries: DataFrame, first: bool) -> DataFrame:
        both = index.unionByName(queries.mapInArrow(_deal(pivots, table, kind, first), packed))
        return both.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_search(pivots, kind, keep, wide), FOUND)

    at_least = F.lit(float("-inf")).alias("at_least")
    near = look(asked.select("id", "vec", at_least), True)
    near = materialize(near.repartition(n, "qid").sortWithinPartitions("qid").mapInArrow(_merge(keep, packed=True), FOUND + ", at_least double"))
    rest = look(asked.join(near.select(F.col("qid").alias("id"), "at_least"), "id", "left").select("id", "vec", F.coalesce("at_least", at_least).alias("at_least")), False)
    found = near.drop("at_least").unionByName(rest)
    best = materialize(found.repartition(n, "qid").sortWithinPartitions("qid").mapInArrow(_merge(keep), "query_id long, class long, score long"))
    out = best.join(members.select("class", F.col("id").alias("vec_id")), "class").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    discard(made, index, asked, near)
    return out.select("query_id", "rank", "vec_id", "score")
