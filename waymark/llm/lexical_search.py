"""Ranked lexical search by branch and bound over tries of documents.

A document is restricted to the terms of the items asked.  Its terms, in order
of falling document frequency, are a path; documents are range-partitioned and
sorted by path, so that in each block of them shared prefixes are the nodes of a
trie (a document FP-tree).  A subtree knows the largest tf of each of its terms,
its least m and its least doc_id; with them no document below scores more than

    sum of w * ((10^9 * tf) div (1000 * tf + 20 * m))

over an item's terms.  Each item goes down depth-first, the child with the
largest bound first, and leaves out what can't reach its k-th best so far.  The
bound holds for every document, so the ranks are exact.

Every task returns its k best of each item, and a window ranks them.  Before
that a bounded sample of documents gives each item a score that its k-th best
must reach; it changes cost only.  Items are handled in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import text_chunks, words
from .shared import NO_ID, discard, materialize, shuffle_partitions

#: Items, and terms of items, of one block.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 4096, 1 << 20
#: Documents of a trie, of a leaf, and of the sample that gives first thresholds.
TRIE_DOCS, LEAF_DOCS, SAMPLE_DOCS = 16_384, 48, 4096
#: Terms in the paths of one trie, at most (or one document's).
TRIE_TERMS = 1 << 22
#: Bytes between terms: all of ASCII but 0-9, A-Z and a-z.
GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
VECTOR = "doc_id long, n long, terms binary, tfs binary"
PATH = "path binary, tfs binary, m long, doc_id long"
HIT = "item int, doc_id long, score long"


def _terms():
    """(item_id, terms): the hashes of the distinct terms of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                h, per_row = words(data, offsets, gaps=GAPS)
                ends = np.cumsum(per_row)
                found = [np.unique(h[e - c : e]).view(np.int64) for e, c in zip(ends.tolist(), per_row.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, pa.list_(pa.int64()))], names=["item_id", "terms"])

    return run


def _restrict(known):
    """Number of terms of each document that has any, and those of ``known`` (sorted hashes) by place and tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID)
            for first, data, offsets in text_chunks(batch.column(1)):
                h, per_row = words(data, offsets, gaps=GAPS)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == h)
                row = np.repeat(np.arange(len(per_row)), per_row)[hit]
                code, tf = np.unique(row * len(vocabulary) + at[hit], return_counts=True)
                row, term, tf = code // len(vocabulary), (code % len(vocabulary)).astype("<i4"), tf.astype("<i4")
                edge = np.searchsorted(row, np.arange(len(per_row) + 1))
                some = np.flatnonzero(per_row)
                spans = [(edge[i], edge[i + 1]) for i in some.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(per_row)).take(pa.array(some)), pa.array(per_row[some]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (term, tf))],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


def _frequencies(size: int):
    """How many documents of a partition hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i4")
            np.add.at(count, held, 1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["term", "df"])

    return run


def _paths(place, documents: int, terms: int):
    """Terms become their places in the order of frequency, as big-endian numbers that sort like the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, tfs = [], []
            for t, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at = place.value[np.frombuffer(t, dtype="<i4")]
                order = np.argsort(at)
                paths.append(at[order].astype(">i4").tobytes())
                tfs.append(np.frombuffer(f, dtype="<i4")[order].tobytes())
            m = [50 + 50 * n * documents // terms for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(tfs, pa.binary()), pa.array(m, pa.int64()), batch.column(0)], names=["path", "tfs", "m", "doc_id"])

    return run


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Trie:
    """The trie of a block of documents sorted by path."""

    def __init__(self, paths: list[bytes], tfs: list[bytes], m: np.ndarray, ids: np.ndarray):
        sizes = np.array([len(p) // 4 for p in paths])
        self.ptr = np.concatenate(([0], np.cumsum(sizes)))
        self.term = np.frombuffer(b"".join(paths), dtype=">i4").astype(np.int64)
        tf = np.frombuffer(b"".join(tfs), dtype="<i4").astype(np.int64)
        self.m, self.ids = m, ids
        self.gain = _impact(tf, np.repeat(m, sizes))
        self._shared = self._shared_prefixes(sizes)
        self._build(tf)

    def _shared_prefixes(self, sizes: np.ndarray) -> np.ndarray:
        """How many terms the path of each document shares with the one before."""
        shared = np.zeros(len(sizes), dtype=np.int64)
        open_, depth = np.arange(1, len(sizes)), 0
        while len(open_):
            open_ = open_[(sizes[open_] > depth) & (sizes[open_ - 1] > depth)]
            open_ = open_[self.term[self.ptr[open_] + depth] == self.term[self.ptr[open_ - 1] + depth]]
            shared[open_] += 1
            depth += 1
        return shared

    def _parts(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The ranges of documents under a node: one per next term, small neighbours together."""
        inner = self._shared[lo + 1 : hi]
        cuts = (np.flatnonzero(inner == inner.min()) + lo + 1).tolist() if len(inner) else []
        out: list[tuple[int, int]] = []
        for a, b in zip([lo, *cuts], [*cuts, hi], strict=True):
            if out and b - out[-1][0] <= LEAF_DOCS:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def _build(self, tf: np.ndarray) -> None:
        self.children: list[list[int]] = []  # of a node; a leaf is -1 - its number
        self.leaves: list[tuple[int, int]] = []
        ranges = [(0, len(self.ids))]
        at = 0
        while at < len(ranges):  # parents come before their children
            lo, hi = ranges[at]
            mine = []
            for a, b in self._parts(lo, hi):
                if b - a <= LEAF_DOCS or (a, b) == (lo, hi):
                    for c in range(a, b, LEAF_DOCS):
                        self.leaves.append((c, min(b, c + LEAF_DOCS)))
                        mine.append(-len(self.leaves))
                else:
                    ranges.append((a, b))
                    mine.append(len(ranges) - 1)
            self.children.append(mine)
            at += 1
        below: dict[int, tuple] = {-1 - k: self._summary(self.term[self.ptr[a] : self.ptr[b]], tf[self.ptr[a] : self.ptr[b]], self.m[a:b].min(), self.ids[a:b].min()) for k, (a, b) in enumerate(self.leaves)}
        #: Of all children of a node together: terms, bounds of their gain, where each child starts, least ids.
        self.bounds: list[tuple] = [()] * len(ranges)
        for node in range(len(ranges) - 1, -1, -1):
            parts = [below.pop(c) for c in self.children[node]]
            starts = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1]
            term, most = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            least_m, least_id = np.array([p[2] for p in parts]), np.array([p[3] for p in parts])
            self.bounds[node] = (term, _impact(most, np.repeat(least_m, [len(p[0]) for p in parts])), starts, least_id)
            below[node] = self._summary(term, most, least_m.min(), least_id.min())

    @staticmethod
    def _summary(term: np.ndarray, tf: np.ndarray, least_m: int, least_id: int) -> tuple:
        order = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], term[order][1:] != term[order][:-1])))
        return term[order][first], np.maximum.reduceat(tf[order], first), least_m, least_id

    def search(self, weight: np.ndarray, best: Best) -> None:
        """Depth-first; ``weight`` has the item's weight of each term, 0 for others."""
        stack = [(None, 0, 0)]
        while stack:
            bound, least_id, node = stack.pop()
            if bound is not None and not best.may_take(bound, least_id):
                continue
            if node < 0:
                a, b = self.leaves[-1 - node]
                x, y = self.ptr[a], self.ptr[b]
                best.take(np.add.reduceat(weight[self.term[x:y]] * self.gain[x:y], self.ptr[a:b] - x), self.ids[a:b])
                continue
            term, gain, starts, least_ids = self.bounds[node]
            bounds = np.add.reduceat(weight[term] * gain, starts)
            good = np.flatnonzero(bounds >= best.least)
            for k in good[np.argsort(bounds[good], kind="stable")].tolist():  # the last is opened first
                stack.append((int(bounds[k]), int(least_ids[k]), self.children[node][k]))


class Best:
    """The k best of one item so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)  # a score has to reach ``least``
        self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def may_take(self, bound: int, least_id: int) -> bool:
        full = len(self.score) == self.k
        return bound > self.score[-1] or (bound == self.score[-1] and least_id < self.ids[-1]) if full else bound >= self.least

    def take(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score, ids = np.concatenate((self.score, score[good])), np.concatenate((self.ids, ids[good]))
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Trie]:
    """Tries of consecutive rows; of rows that differ in doc_id only the first k can be in a result."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    last, nth, size = None, 0, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nth = nth + 1 if row[:3] == last else 1
            last = row[:3]
            if nth > k:
                continue
            for to, x in zip(held, row, strict=True):
                to.append(x)
            size += len(row[0]) // 4
            if len(held[0]) == TRIE_DOCS or size > TRIE_TERMS:
                yield Trie(held[0], held[1], np.array(held[2]), np.array(held[3]))
                held, size = ([], [], [], []), 0
    if held[0]:
        yield Trie(held[0], held[1], np.array(held[2]), np.array(held[3]))


def _search(asked, k: int, least):
    """The k best of each item among the rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = asked.value
        best = [Best(k, at) for at in (least.value if least else [1] * len(items))]
        weight = np.zeros(len(weights), dtype=np.int64)
        for trie in _blocks(batches, k):
            for terms, found in zip(items, best, strict=True):
                weight[terms] = weights[terms]
                trie.search(weight, found)
                weight[terms] = 0
        for i, found in enumerate(best):
            if len(found.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.ids), i, dtype=np.int32)), pa.array(found.ids), pa.array(found.score)], names=["item", "doc_id", "score"])

    return run


def _item_blocks(items: DataFrame, item_col: str) -> Iterator[list]:
    """Lists of (item_id, hashes of its terms), of bounded size; items come to the driver block by block."""
    named = items.select(F.col(item_col).alias("item_id"), F.col("text").cast("string").alias("text"))
    id_type = named.schema["item_id"].dataType.simpleString()
    found = named.mapInArrow(_terms(), f"item_id {id_type}, terms array<long>").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    block, size = [], 0
    for r in found.where(F.size("terms") > 0).toLocalIterator():
        block.append((r["item_id"], np.array(r["terms"], dtype=np.int64).view(np.uint64)))
        size += len(r["terms"])
        if len(block) == ITEMS_AT_ONCE or size >= TERMS_AT_ONCE:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(docs: DataFrame, block: list, id_type: str, k: int) -> DataFrame | None:
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    share = spark.sparkContext.broadcast  # all of them have a row per item or term of one block
    vocabulary = np.unique(np.concatenate([t for _, t in block]))
    vectors = materialize(docs.mapInArrow(_restrict(share(vocabulary)), VECTOR))
    documents, terms = vectors.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        discard(vectors)
        return None
    useful = vectors.where(F.octet_length("terms") > 0)
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in useful.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(df), dtype=np.int64)
    place[order] = np.arange(len(df))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in df[order].tolist()], dtype=np.int64)
    asked = share((weights, [place[np.searchsorted(vocabulary, t)] for _, t in block]))
    paths = useful.mapInArrow(_paths(share(place), documents, terms), PATH)
    sample = useful.sample(min(1.0, SAMPLE_DOCS / documents), seed=11).mapInArrow(_paths(share(place), documents, terms), PATH)
    first = sample.repartition(1).sortWithinPartitions("path", "tfs", "m", "doc_id").mapInArrow(_search(asked, k, None), HIT)
    least = [1] * len(block)
    for r in first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).collect():
        least[r["item"]] = r["kth"]
    near = [F.substring("path", 1, 32), F.xxhash64("path"), F.xxhash64("tfs", "m"), F.col("doc_id")]  # short, as bounds are drawn from a sample of them
    ranged = paths.repartitionByRange(n, *near).sortWithinPartitions("path", "tfs", "m", "doc_id")
    hits = ranged.mapInArrow(_search(asked, k, share(least)), HIT)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    hits = materialize(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    discard(vectors)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {id_type}")
    return hits.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents that score highest for each item, exactly.

    Terms are runs of 0-9, A-Z, a-z and characters beyond ASCII, with A-Z
    lower-cased, compared by 64-bit hashes.  With N documents that have terms,
    L terms in all, n terms in a document and df documents holding a term,
    w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and a
    document scores the sum over the item's distinct terms of
    w * ((10^9 tf) div (1000 tf + 20 m)).  Only scores above 0 count; equal
    ones rank by doc_id.

    Null and empty texts have no terms: such documents don't count, such items
    have no rows.  Rows that repeat a document are documents of their own, also
    under one id; rows without an id rank before others of the same score.
    Rows of one item_id (null included) are one item, of all their terms.  Empty
    tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in _item_blocks(items, item_col):
        found = _search_block(rows, block, id_type, k)
        out = out if found is None else out.unionByName(found)
    return out
