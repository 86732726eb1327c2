"""Exact set-similarity self-join of texts on word shingles with PartEnum signatures.

Two texts link when the Jaccard similarity of their sets of distinct word
shingles reaches the threshold.  Sets fall into bands of similar size.  In each
band the feature domain (shingle hashes) is partitioned, and the subsets of
partitions of one member each are enumerated: a signature is the projection of
a set on one partition.  A set with Jaccard similarity t to another differs
from it in at most k = (1 - t) / (1 + t) * (|A| + |B|) features, and each
difference spoils one partition, so of the non-empty projections at most k are
not shared.  Under any order of signatures that all sets agree on, the first
k + 1 of each set therefore hold a shared one, and only those are sent.

The order puts signatures last that consist of very common shingles alone, so
passages that many texts share make no candidates unless a text has little
else.  The list of common shingles is bounded; it changes cost, not results.

Sets that share a signature form candidate groups.  A lower bound of the set
difference from coarse histograms thins them: in each group one member, the
pivot, is compared with all others where they are, so nothing is gathered, and
what it may link with gets its label.  Groups whose members all have one label
are done, as links inside a label can't change it; in the others the members
outside the commonest label are compared with all, block against block.

The labels are families, which hold every link.  Within a family whole sets
are compared exactly.  For components alone that is done by pivots again; to
count the links of each set, as the query does, all blocks of a family meet.

Copies are one class: only distinct sets take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import mix, set_id, shingle_sets
from .shared import NO_ID, components, discard, groups, materialize, shuffle_partitions

_U = np.uint64
#: Up to this size each feature is a partition of its own.
SINGLE_UP_TO = 64
#: Bands end at SINGLE_UP_TO * BAND_RATIO ** i; at a band's upper end a partition holds DENSITY features on average.
BAND_RATIO, DENSITY = 4, 2.0
#: A shingle is called common from this many occurrences in one batch; the commonest COMMON_MOST are broadcast (8 bytes each).
COMMON_IN_BATCH, COMMON_MOST = 8, 100_000
#: Most members of a block, on average, and features of its sets; a pair of blocks is the unit of comparison.
BLOCK, BLOCK_FEATURES = 2048, 1 << 20
#: Features that at most so many sets of a pair of blocks hold are counted pair by pair, others by matrix products.
LIGHT = 8
#: Up to this many candidate rows (24 bytes each) go to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _bands(n: int, t: Fraction) -> list[tuple[int, int]]:
    """(band, largest difference) in which a set of n features looks for partners."""
    top, band = SINGLE_UP_TO, 0
    while n > top:
        top *= BAND_RATIO
        band += 1
    rate = (1 - t) / (1 + t)
    most = math.floor(n / t)
    out = [(band, math.floor(rate * (n + min(most, top))))]
    if most > top:
        out.append((band + 1, math.floor(rate * (n + most))))
    return out


#: Signatures of one partition each need more non-empty partitions than allowed differences, which hashing gives (beyond 10 sigma) from here on.
LEAST_THRESHOLD = 0.8


def _partitions(band: int) -> int:
    return int(SINGLE_UP_TO * BAND_RATIO**band / DENSITY)


def signatures(s: np.ndarray, t: Fraction, common: np.ndarray) -> np.ndarray:
    """The signatures of a sorted set under threshold t; sets that link share one."""
    n = len(s)
    out = []
    rare = np.ones(n, dtype=bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rare = common[at] != s
    for band, k in _bands(n, t):
        if band == 0:
            sig, size, light = mix(s ^ _U(0xA5A5)), np.ones(n, dtype=np.int64), rare
        else:
            part = ((s >> _U(32)) * _U(_partitions(band))) >> _U(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            size = np.diff(np.append(first, n))
            light = np.logical_or.reduceat(rare, first)
            sig = mix(np.add.reduceat(mix(s ^ _U(band)), first) + (part[first] << _U(8)) + _U(band))
        if len(sig) <= k:
            raise AssertionError("fewer signatures than differences allowed")  # beyond 10 sigma for hashed features
        if len(sig) > k + 1:
            rank = np.where(light, 0, 4) + (3 - np.minimum(size, 3))
            order = np.lexsort((sig, rank))[: k + 1]
            sig = sig[order]
        out.append(sig)
    return np.unique(np.concatenate(out))


def _cells(n: int) -> int:
    return 1 << max(3, math.ceil(math.log2(max(n, 1) / 6 + 1)))


def histogram(s: np.ndarray) -> np.ndarray:
    """Counts of features in equal ranges of the domain, at most 255 each."""
    cells = _cells(len(s))
    at = (s >> _U(64 - cells.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=cells), 255).astype(np.uint8)


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, hist, all_s = [], [], [], []
            for _, s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                ids.append(set_id(s))
                hist.append(histogram(s).tobytes() if len(s) else b"")
                all_s.append(s)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * rows, pa.string()), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(hist, pa.binary())],
                names=["kind", "doc_id", "h", "n", "sid", "hist"],
            )
            flat = np.sort(np.concatenate(all_s)) if all_s else np.zeros(0, dtype=np.uint64)
            if len(flat) >= COMMON_IN_BATCH:
                first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
                count = np.diff(np.append(first, len(flat)))
                often = count >= COMMON_IN_BATCH
                m = int(often.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["common"] * m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(count[often], pa.int64()), pa.array(flat[first[often]].view(np.int64), pa.int64()), pa.nulls(m, pa.binary())],
                    names=["kind", "doc_id", "h", "n", "sid", "hist"],
                )

    return run


def _sign(size: int, t: Fraction, common, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        seen: set[int] = set()
        for batch in batches:
            sigs, sids = [], []
            for _, s in shingle_sets(batch.column(0), size):
                if not len(s):
                    continue
                sid = set_id(s)
                if sid in seen:
                    continue
                if len(seen) < 1_000_000:  # a copy that is sent again is merged later
                    seen.add(sid)
                sigs.append(signatures(s, t, known))
                sids.append(sid)
            if not sigs:
                continue
            owner = np.repeat(np.arange(len(sids), dtype=np.uint32), [len(x) for x in sigs])
            sig = np.concatenate(sigs)
            bucket = (sig % _U(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            sig, owner, bucket = sig[order], owner[order], bucket[order]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            rows: tuple[list, ...] = ([], [], [], [])
            sid_arr = np.array(sids, dtype=np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sig)], strict=True):
                own, count = np.unique(owner[a:b], return_counts=True)
                rows[0].append(int(bucket[a]))
                rows[1].append((sig[a:b] >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())  # 48 bits within a bucket
                rows[2].append(sid_arr[own].tobytes())
                rows[3].append(count.astype("<u2").tobytes() if count.max() < 65536 else count.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "sigs", "sids", "counts"]
            )

    return run


def _shared_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, size, pos, sid) for each distinct group of two or more sets that share a signature; a bucket at a time."""
    known: set[int] = set()
    for table in groups(batches, "bucket"):
        sigs, sids = [], []
        for x, ids, counts in zip(*(table.column(c).to_pylist() for c in ("sigs", "sids", "counts")), strict=True):
            raw = np.zeros((len(x) // 6, 8), dtype=np.uint8)
            raw[:, :6] = np.frombuffer(x, dtype=np.uint8).reshape(-1, 6)
            own = np.frombuffer(ids, dtype=np.int64)
            sigs.append(raw.view("<u8").ravel())
            sids.append(np.repeat(own, np.frombuffer(counts, dtype="<u2" if len(counts) == 2 * len(own) else "<u4")))
        sig, sid = np.concatenate(sigs), np.concatenate(sids)
        order = np.argsort(sig)
        sig, sid = sig[order], sid[order]
        same = sig[1:] == sig[:-1]
        keep = np.zeros(len(sig), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        sig, sid = sig[keep], sid[keep]
        if not len(sig):
            continue
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])))
        sig, sid = sig[new], sid[new]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(first, len(sig)))
        gid = mix(np.add.reduceat(mix(sid.view(np.uint64)), first) + count.astype(np.uint64))
        gids, members = [], []
        for g, a, c in zip(gid.view(np.int64).tolist(), first.tolist(), count.tolist(), strict=True):
            if c < 2 or g in known:
                continue
            if len(known) < 1_000_000:  # a group that is sent again is merged later
                known.add(g)
            gids.append(g)
            members.append(sid[a : a + c])
            if len(gids) >= 20_000:
                yield _group_rows(gids, members)
                gids, members = [], []
        if gids:
            yield _group_rows(gids, members)


def _group_rows(gids: list[int], members: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(members)
    size = [len(m) for m in members]
    pos = np.concatenate([np.arange(n) for n in size])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array(gids), size)), pa.array(np.repeat(np.array(size), size), pa.int64()), pa.array(pos, pa.int64()), pa.array(flat)],
        names=["gid", "size", "pos", "sid"],
    )


class _Histograms:
    """Which sets may link: their histograms don't rule it out."""

    def __init__(self, t: Fraction, left: pa.Table, right: pa.Table):
        self.up, self.down = t.denominator + t.numerator, t.denominator - t.numerator
        self.left, self.n_left, self.n = left.column("body").to_pylist(), left.column("n").to_numpy(), right.column("n").to_numpy()
        levels: dict[int, list[int]] = {}
        bodies = right.column("body").to_pylist()
        for k, h in enumerate(bodies):
            levels.setdefault(len(h), []).append(k)
        self.slot = np.empty(len(bodies), dtype=np.int64)
        self.levels = {}
        for cells, rows in levels.items():
            self.slot[rows] = np.arange(len(rows))
            self.levels[cells] = np.frombuffer(b"".join(bodies[k] for k in rows), dtype=np.uint8).reshape(len(rows), cells).astype(np.int32)
        self.cells = np.array([len(h) for h in bodies])

    def row(self, x: int, wanted: np.ndarray) -> np.ndarray:
        """Those of the right rows ``wanted`` that left row ``x`` may link with."""
        own, found = np.frombuffer(self.left[x], dtype=np.uint8).astype(np.int32), []
        for cells, h in self.levels.items():
            if cells not in (len(own) // 2, len(own), len(own) * 2):
                continue
            who = wanted[self.cells[wanted] == cells]
            if len(who):
                found.append(who[_may_link(own[None, :], h[self.slot[who]], np.full(len(who), self.n_left[x]), self.n[who], self.up, self.down)])
        return np.concatenate(found) if found else wanted[:0]


def _may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, up: int, down: int) -> np.ndarray:
    """By rows of histograms, of which one side may have twice the cells of the other."""
    if a.shape[1] > b.shape[1]:
        a = a.reshape(len(a), -1, 2).sum(2)
    elif b.shape[1] > a.shape[1]:
        b = b.reshape(len(b), -1, 2).sum(2)
    # counts that were cut at 255 bound nothing
    cut = np.maximum(a.max(axis=1, initial=0), b.max(axis=1, initial=0)) >= 255
    gap = np.where(cut, 0, np.abs(a - b).sum(1))
    return np.maximum(gap, np.abs(n_a - n_b)) * up <= down * (n_a + n_b)


class _Features:
    """Which sets link, from their features."""

    def __init__(self, t: Fraction, left: pa.Table, right: pa.Table):
        self.matrix = _links(t, _sets(left), _sets(right))

    def row(self, x: int, wanted: np.ndarray) -> np.ndarray:
        return wanted[self.matrix[x, wanted]]


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(f, dtype=np.uint64) for f in table.column("body").to_pylist()]


def _links(t: Fraction, left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The matrix of links, exactly."""
    n_left, n_right = np.array([len(f) for f in left]), np.array([len(f) for f in right])
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.append(n_left, n_right))
    order = np.argsort(flat, kind="stable")  # lefts come before rights within a feature
    flat, owner = flat[order], owner[order]
    feature = np.cumsum(np.concatenate(([True], flat[1:] != flat[:-1]))) - 1
    is_left = owner < len(left)
    in_left = np.bincount(feature[is_left], minlength=feature[-1] + 1)
    in_right = np.bincount(feature[~is_left], minlength=feature[-1] + 1)
    both, total = (in_left > 0) & (in_right > 0), in_left + in_right
    inter = np.zeros(len(left) * len(right), dtype=np.int64)

    light = both & (total <= LIGHT)
    a, b = is_left & light[feature], ~is_left & light[feature]
    times = in_right[feature[a]]
    if len(times):
        starts = np.cumsum(np.where(light, in_right, 0)) - np.where(light, in_right, 0)
        at = np.repeat(starts[feature[a]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        inter += np.bincount(np.repeat(owner[a], times) * len(right) + owner[b][at] - len(left), minlength=len(inter))
    inter = inter.reshape(len(left), len(right))

    heavy = both & (total > LIGHT)
    column = np.cumsum(heavy) - 1
    keep = heavy[feature]
    column, owner, is_left = column[feature[keep]], owner[keep], is_left[keep]
    for start in range(0, int(heavy.sum()), width):
        p, q = np.searchsorted(column, (start, start + width))
        sides = []
        for side, rows, shift in ((is_left[p:q], len(left), 0), (~is_left[p:q], len(right), len(left))):
            m = np.zeros((rows, width), dtype=np.float32)
            m[owner[p:q][side] - shift, column[p:q][side] - start] = 1
            sides.append(m)
        inter += (sides[0] @ sides[1].T).astype(np.int64)
    return inter * t.denominator >= t.numerator * (n_left[:, None] + n_right[None, :] - inter)


class _Labels:
    """Labels of the rows of a pair of blocks, merged as links are found."""

    def __init__(self, *labels: np.ndarray):
        self.names, at = np.unique(np.concatenate(labels), return_inverse=True)
        self.root = np.arange(len(self.names))
        self.sides = np.split(at, np.cumsum([len(x) for x in labels])[:-1])

    def merge(self, labels: np.ndarray) -> None:
        found = np.unique(labels)
        if len(found) > 1:
            self.root[np.isin(self.root, found)] = found[0]

    def edges(self) -> pa.RecordBatch:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.root[moved]]), pa.array(self.names[moved])], names=["a", "b"])


def _with_pivot(t: Fraction, exact: bool):
    """Rows (pivot, p_n, p_body, sid, n, body), each on its own: the links of the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            n_a, n_b = col("p_n").to_numpy(), col("n").to_numpy()
            ok = np.zeros(batch.num_rows, dtype=bool)
            a, b = col("p_body").to_pylist(), col("body").to_pylist()
            if exact:
                for k, (x, y) in enumerate(zip(a, b, strict=True)):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    ok[k] = inter * t.denominator >= t.numerator * (len(x) + len(y) - inter)
            else:
                shape = np.array([len(x) << 32 | len(y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
                for s in np.unique(shape):
                    if not s & 0xFFFFFFFF <= 2 * (s >> 32) <= 4 * (s & 0xFFFFFFFF):
                        continue
                    for rows in np.array_split(np.flatnonzero(shape == s), max(1, int((shape == s).sum() * s >> 32) >> 22)):
                        h = [np.frombuffer(b"".join([z[k] for k in rows.tolist()]), dtype=np.uint8).reshape(len(rows), -1).astype(np.int32) for z in (a, b)]
                        ok[rows] = _may_link(*h, n_a[rows], n_b[rows], t.denominator + t.numerator, t.denominator - t.numerator)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([col("pivot").filter(keep), col("sid").filter(keep)], names=["a", "b"])

    return run


def _rest_with_all(t: Fraction, exact: bool):
    """Links between different labels, within each pair of blocks of a group: side 0 is the rest, side 1 are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gid", "i", "j"):
            side = table.column("side").to_numpy()
            left, right = (table.take(np.flatnonzero(side == k)) for k in (0, 1))
            if not left.num_rows or not right.num_rows:
                continue
            labels = _Labels(left.column("label").to_numpy(), right.column("label").to_numpy())
            mine, theirs = labels.sides
            match = None
            for x in range(left.num_rows):
                other = np.flatnonzero(labels.root[theirs] != labels.root[mine[x]])
                if len(other):
                    match = match or (_Features if exact else _Histograms)(t, left, right)
                    found = match.row(x, other)
                    if len(found):
                        labels.merge(labels.root[np.append(theirs[found], mine[x])])
            yield labels.edges()

    return run


def _blocks(members: F.Column, features: F.Column | None = None) -> F.Column:
    """How many blocks: a power of two, so that groups of about the same members deal them alike."""
    most = members / BLOCK
    if features is not None:
        most = F.greatest(most, features / BLOCK_FEATURES)
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), most)))).cast("long")


def link_labels(members: DataFrame, t: Fraction, exact: bool) -> DataFrame:
    """(v, c), written: labels of the sets that links within the groups of ``members`` reach; sets without links are left out.

    ``members`` are (gid, size, sid, n, body), written once; body is a
    histogram, or the features if ``exact``.  Rows made grow in proportion to
    a group's size as long as its members have one label after the pivot.
    """
    keys = members.select("gid", "size", "sid", "n")
    order = F.struct(F.xxhash64("sid", "gid"), "sid")
    pivots = materialize(keys.groupBy("gid").agg(F.min(order).alias("p")).select("gid", F.col("p.sid").alias("pivot")))
    bodies = members.join(pivots.withColumnRenamed("pivot", "sid"), ["gid", "sid"]).select("gid", F.col("sid").alias("pivot"), F.col("n").alias("p_n"), F.col("body").alias("p_body"))
    pairs = members.join(bodies, "gid").where("sid <> pivot").select("pivot", "p_n", "p_body", "sid", "n", "body")
    first = components(pairs.mapInArrow(_with_pivot(t, exact), "a long, b long"))

    # groups of two are settled by the pivot
    open_ = keys.where("size > 2").join(first.withColumnRenamed("v", "sid"), "sid", "left").select("gid", "sid", "n", F.coalesce("c", "sid").alias("label"))
    per = open_.groupBy("gid", "label").agg(F.count("*").alias("members"), F.sum("n").alias("features"))
    per = per.groupBy("gid").agg(F.max(F.struct("members", "label")).alias("top"), F.count("*").alias("labels"), F.sum("members").alias("members"), F.sum("features").alias("features"))
    per = per.where("labels > 1").select("gid", F.col("top.label").alias("main"), "members", (F.col("members") - F.col("top.members")).alias("rest"), "features")
    sizes = (F.col("features"),) if exact else ()
    left_blocks = _blocks(F.col("rest"), *(x * F.col("rest") / F.col("members") for x in sizes))
    todo = materialize(open_.join(per, "gid").join(pivots, "gid").where("sid <> pivot").select("gid", "sid", "label", "main", left_blocks.alias("lefts"), _blocks(F.col("members"), *sizes).alias("rights")))
    own = F.xxhash64("sid")
    left = todo.where("label <> main").select("gid", "sid", "label", F.lit(0).alias("side"), F.pmod(own, F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("j"))
    right = todo.select("gid", "sid", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"), F.pmod(own, F.col("rights")).alias("j"))
    dealt = left.unionByName(right).join(members.select("gid", "sid", "n", "body"), ["gid", "sid"])
    dealt = dealt.repartition(shuffle_partitions(members.sparkSession), "gid", "i", "j").sortWithinPartitions("gid", "i", "j")
    second = components(dealt.mapInArrow(_rest_with_all(t, exact), "a long, b long"))

    out = first.unionByName(second.select("v", F.col("v").alias("c"))).distinct().withColumnRenamed("c", "label")
    out = materialize(out.join(second.withColumnRenamed("v", "label"), "label", "left").select("v", F.coalesce("c", "label").alias("c")))
    discard(pivots, first, second, todo)
    return out


def _fetch(size: int):
    """The sets of the texts that stand for a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            sid = col("sid").to_pylist()
            sets = [s.tobytes() if set_id(s) == sid[row] else None for row, s in shingle_sets(col("text"), size)]
            out = pa.RecordBatch.from_arrays([*(col(c) for c in ("gid", "size", "features", "sid", "n", "copies")), pa.array(sets, pa.large_binary())], names=["gid", "size", "features", "sid", "n", "copies", "body"])
            yield out.filter(pa.array([s is not None for s in sets]))

    return run


def _count_links(t: Fraction):
    """(a, b, links) for each pair of blocks of a family: the label of b among them, and the rows it links with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gid", "i", "j"):
            own, sid, copies = (table.column(c).to_numpy() for c in ("own", "sid", "copies"))
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            sets = _sets(table)
            matrix = _links(t, [sets[k] for k in left], [sets[k] for k in right])
            links = np.zeros(len(sid), dtype=np.int64)
            if i == j:
                np.fill_diagonal(matrix, False)
            else:
                links[right] += copies[left] @ matrix
            links[left] += matrix @ copies[right]
            labels = _Labels(np.arange(len(sid)))
            for x in np.flatnonzero(matrix.any(axis=1)).tolist():
                labels.merge(labels.root[np.append(right[matrix[x]], left[x])])
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(sid[labels.root[hit]]), pa.array(sid[hit]), pa.array(links[hit])], names=["a", "b", "links"])

    return run


def block_pairs(df: DataFrame) -> DataFrame:
    """Rows (gid, blocks, sid, ...) go once to each pair of blocks (i <= j) that their block is part of."""
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    return df.withColumns({"own": own, "at": F.explode(at)}).select("gid", "at.i", "at.j", "own", "sid", "copies", "body")


def _linked_rows(docs: DataFrame, threshold: float, size: int, id_col: str, text_col: str, count_links: bool) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, n_links), written; h is a hash of the text."""
    spark = docs.sparkSession
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"threshold is from {LEAST_THRESHOLD} to 1: below it a set may have fewer signatures than a partner may differ in")
    t = Fraction(threshold).limit_denominator(10_000)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    first = materialize(texts.mapInArrow(_profile(size), "kind string, doc_id long, h long, n long, sid long, hist binary"), "kind")
    rows = first.where("kind = 'doc'").select("doc_id", "h", "n", "sid")
    top = first.where("kind = 'common'").groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sid").limit(COMMON_MOST).select("sid").toArrow()
    common = spark.sparkContext.broadcast(np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64)))

    did = F.coalesce("doc_id", F.lit(NO_ID))
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), did.alias("did"), "h")).alias("at"), F.count("*").alias("copies"))
    classes = materialize(classes.select("sid", "least", "at.did", "at.h", "copies"))
    # a histogram per class, from any of its rows: they are equal
    hists = first.where("kind = 'doc' AND n > 0").select("sid", "n", F.col("hist").alias("body"))

    buckets = 4 * shuffle_partitions(spark)
    signed = texts.select("text").mapInArrow(_sign(size, t, common, buckets), "bucket long, sigs binary, sids binary, counts binary")
    signed = signed.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    shared = materialize(signed.mapInArrow(_shared_groups, "gid long, size long, pos long, sid long").dropDuplicates(["gid", "pos"]))
    known = hists.join(shared.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])
    members = materialize(shared.join(known, "sid").select("gid", "size", "sid", "n", "body"))
    families = link_labels(members, t, exact=False)
    discard(shared)

    sizes = families.withColumnRenamed("v", "sid").join(members.select("sid", "n").distinct(), "sid")
    sizes = materialize(sizes.withColumnRenamed("c", "gid"))
    totals = sizes.groupBy("gid").agg(F.count("*").alias("size"), F.sum("n").alias("features"))
    placed = materialize(sizes.join(totals, "gid").join(classes, "sid").select("gid", "size", "features", "sid", "n", "copies", "did", F.col("h").alias("th")))
    few = placed.count() <= BROADCAST_ROWS
    chosen = texts.select(did.alias("own"), "h", "text").join(F.broadcast(placed) if few else placed, (F.col("own") == F.col("did")) & (F.col("h") == F.col("th")))
    sets = chosen.mapInArrow(_fetch(size), "gid long, size long, features long, sid long, n long, copies long, body binary").dropDuplicates(["gid", "sid"])
    if count_links:
        sets = block_pairs(sets.withColumn("blocks", _blocks(F.col("size"), F.col("features"))))
        dealt = sets.repartition(shuffle_partitions(spark), "gid", "i", "j").sortWithinPartitions("gid", "i", "j")
        found = materialize(dealt.mapInArrow(_count_links(t), "a long, b long, links long"))
        labels = components(found.select("a", "b"))
        links = found.groupBy(F.col("b").alias("sid")).agg(F.sum("links").alias("links"))
        used = (found, labels)
    else:
        sets = materialize(sets)
        labels, links = link_labels(sets, t, exact=True), None
        used = (sets, labels)
    labels = labels.withColumnRenamed("v", "sid")
    names = labels.join(classes.select("sid", "least"), "sid").groupBy("c").agg(F.min("least").alias("name"))
    named = classes.select("sid", "least", "copies").join(labels.join(names, "c").select("sid", "c", "name"), "sid", "left")
    named = named.select("sid", "copies", F.when(F.col("c").isNull(), F.col("least")).otherwise(F.col("name")).alias("component"))
    counted = F.lit(None).cast("long")
    if links is not None:
        named, counted = named.join(links, "sid", "left"), F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    named = materialize(named)
    out = rows.join(named, "sid", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), counted.alias("n_links"))
    out = materialize(out)
    discard(first, classes, members, families, sizes, placed, named, *used)
    return out


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per row of ``docs``.

    ``component_id`` is the least id that links reach from the row, itself
    included, and ``n_links`` the number of other rows that the row links with,
    copies included.  Counting links takes as many comparisons as a family has
    pairs of distinct sets; with ``count_links`` off n_links is null and
    comparisons grow with the families' sizes alone where pivots settle them.
    Texts that are null or without words are empty and link with nothing, not
    even with each other.  Repeated rows each give a row; rows with a null id
    take part through their text and never name a component (it is null for a
    row that reaches no id).  Ties don't arise: all links count.  An empty
    table gives no rows; other columns are ignored.  ``threshold`` is from
    LEAST_THRESHOLD to 1, else a ValueError.
    """
    return _linked_rows(docs, threshold, size, id_col, text_col, count_links).drop("h")


def keep_one_per_component(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group of near duplicates.

    Rows with equal id and text count as copies and leave one.  Rows with a
    null id stay if no row with an id is linked to them.  An empty table gives
    none; other columns stay as they are, whatever their names.
    """
    found = _linked_rows(docs, threshold, size, "doc_id", "text", count_links=False)
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(did.alias("did"), "h").distinct()
    first = F.row_number().over(Window.partitionBy("did", "h").orderBy(F.lit(0)))
    # texts are dealt by id and hash at every size: there is a row to keep for most documents
    rows = docs.select(did.alias("did"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.struct(*docs.columns).alias("row"))
    return rows.join(keep.hint("merge"), ["did", "h"], "left_semi").withColumn("nth", first).where("nth = 1").select("row.*")
