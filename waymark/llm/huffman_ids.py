"""Token ids as canonical, length-limited Huffman codes in seekable segments.

Texts are range-partitioned by document, encoded once, and cut into segments.
Global counts of all ids give one code of at most MAX_BITS bits; only lengths
are stored, the codes follow from them.  A segment's ids are blocks of
BLOCK_IDS; the bit offset of each block is a checkpoint, so blocks decode
independently, and here all blocks of a segment decode in lock step through a
table that maps the next MAX_BITS bits to an id and its length.

The file format is a table of binary segments, written by Spark's own commit
protocol so that it works on any store Spark writes to:

    magic "WHF2", then little-endian u32: documents, blocks, documents with a null
    id, which come first; i64 doc_id and u32 number of ids for each document;
    u64 bit offset for each block; the bits, first bit highest.

Segments have (part, seq) as their order, which is ascending doc_id.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import text_chunks
from .shared import discard, materialize, shuffle_partitions

MAX_BITS, BLOCK_IDS = 20, 256
#: A segment closes at so many ids; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 19
MAGIC = b"WHF2"
#: Text that is encoded at a time, unless one document is longer.
CHUNK_BYTES = 4 << 20
#: Parts, and bytes of them, that a worker keeps the ids of.
CACHE_PARTS, CACHE_BYTES = 1_000_000, 24 << 20
_tokenizers: dict[str, ChunkTokenizer] = {}
_SPACE, _LETTER, _DIGIT, _MARK, _WIDE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[128:] = _WIDE
_QUOTE, _FEED, _BLANK = b"'\n "


def _solid(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Bytes that end a character which surely isn't white space."""
    out = (kind == _LETTER) | (kind == _DIGIT) | (kind == _MARK)
    wide = np.flatnonzero(kind == _WIDE)
    if len(wide):
        one, two = data[np.maximum(wide - 1, 0)], data[np.maximum(wide - 2, 0)]
        # U+0080 to U+00BF, and the blocks of Unicode's other spaces
        out[wide] = (one != 0xC2) & ~(np.isin(two, (0xE1, 0xE2, 0xE3)) & np.isin(one, (0x9A, 0x80, 0x81)))
    return out


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut: the ids of a text are those of its parts.

    The pre-tokenizer's pieces always end before white space that follows
    something else, after a single line feed, before a mark behind a letter or
    number, and before those behind a mark, but for quotes, which may open a
    contraction.  Rows always start parts.
    """
    kind = _CLASS[data]
    solid = _solid(data, kind)
    plain = solid & (kind != _WIDE)
    word, mark = (kind == _LETTER) | (kind == _DIGIT), kind == _MARK
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 1:
        cut[1:-1] = solid[:-1] & (kind[1:] == _SPACE)
        cut[1:-1] |= word[:-1] & mark[1:]
        cut[1:-1] |= mark[:-1] & (data[:-1] != _QUOTE) & word[1:]
        cut[2:-1] |= plain[:-2] & (data[1:-1] == _FEED) & plain[2:]
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:-1])


class ChunkTokenizer:
    """Byte-level BPE through the tokenizers library, each part of many texts once.

    Texts are cut at :func:`part_starts`, and the parts of a chunk are
    dictionary-encoded; only parts that are new to the worker reach the
    library, many in one text: words behind their spaces fall apart at ids that
    start with a space, others are put between line feeds.  Texts that hold a
    special token's string are one part.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.opens = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.opens[[i for t, i in self.library.get_vocab().items() if t.startswith("\u0120")]] = True
        self.feed = self.library.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.sizes = np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        got = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(got), dtype=self.kind), np.array([len(x) for x in got], dtype=np.int64)

    def _spaced(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of parts that start with their only space."""
        data, ends = _buffers(parts)
        edges = [*ends[:-1:256].tolist(), int(ends[-1])]
        flat, _ = self._encode([bytes(data[a:b]).decode() for a, b in itertools.pairwise(edges)])
        first = np.flatnonzero(self.opens[flat])
        return (flat, np.diff(np.append(first, len(flat)))) if len(first) == len(parts) else self._encode(parts.to_pylist())

    def _bare(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of parts without white space."""
        texts = parts.to_pylist()
        flat, _ = self._encode(["\n".join(texts[k : k + 256]) + "\n" for k in range(0, len(texts), 256)])
        last = np.flatnonzero(flat == self.feed[0])
        if len(self.feed) != 1 or len(last) != len(texts):
            return self._encode(texts)
        return np.delete(flat, last), np.diff(np.append(-1, last)) - 1

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Where the new ``parts`` are kept."""
        data, ends = _buffers(parts)
        kind = _CLASS[data]
        solid = _solid(data, kind)
        spaces = np.diff(np.append(0, np.cumsum(kind == _SPACE))[ends])
        size, first = np.diff(ends), data[ends[:-1]]
        closed = solid[ends[1:] - 1]
        spaced = closed & (spaces == 1) & (first == _BLANK) & (size > 1)
        bare = closed & (spaces == 0) & solid[ends[:-1]] & (kind[ends[:-1]] != _WIDE)
        place = np.empty(len(parts), dtype=np.int64)
        for which, encode in ((spaced, self._spaced), (bare, self._bare), (~spaced & ~bare, lambda x: self._encode(x.to_pylist()))):
            some = parts.filter(pa.array(which))
            if len(some):
                flat, sizes = encode(some)
                place[which] = np.arange(len(some)) + len(self.known)
                self.known = pa.concat_arrays([self.known, some])
                self.flat, self.sizes = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, sizes))
        return place

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row) of rows of UTF-8."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, dtype=self.kind), np.zeros(rows, dtype=np.int64)
        starts = part_starts(data, offsets)
        raw = data.tobytes()
        whole = {int(np.searchsorted(offsets, at, side="right")) - 1 for mark in self.special for at in _found(raw, mark)}
        if whole:
            own = np.searchsorted(offsets, starts, side="right") - 1
            starts = starts[~np.isin(own, list(whole)) | np.isin(starts, offsets)]
        starts = starts[starts < len(data)]
        ends = np.append(starts, len(data)).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw)).dictionary_encode()
        distinct = parts.dictionary
        if len(self.known) > CACHE_PARTS or self.known.nbytes > CACHE_BYTES:
            self._forget()
        found = pc.index_in(distinct, value_set=self.known)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            at[at < 0] = self._learn(distinct.filter(found.is_null()))
        place = at[parts.indices.to_numpy()]
        sizes = self.sizes[place]
        upto = np.append(0, np.cumsum(sizes))
        first = (np.cumsum(self.sizes) - self.sizes)[place]
        flat = self.flat[np.repeat((first - upto[:-1]).astype(np.int32), sizes) + np.arange(upto[-1], dtype=np.int32)]
        return flat, np.diff(upto[np.searchsorted(starts, offsets)])


def _buffers(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings."""
    ends = np.frombuffer(parts.buffers()[1], dtype=np.int64)[parts.offset : parts.offset + len(parts) + 1]
    return np.frombuffer(parts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _found(raw: bytes, mark: bytes) -> Iterator[int]:
    at = raw.find(mark)
    while at >= 0:
        yield at
        at = raw.find(mark, at + 1)


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer of a file."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


_SEGMENT = "part long, seq long, docs long, ids long, nulls long, doc_ids binary, sizes binary, body binary"


def _segments(path: str, end_id: int):
    """Rows (doc_id, text), sorted, to segments of raw ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq = tokenizer(path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def close():
            nonlocal held, count, seq
            null, doc_ids, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [part, seq, len(sizes), len(ids), int(null.sum()), doc_ids.tobytes(), sizes.astype("<u4").tobytes(), ids.tobytes()]
            held, count, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "seq", "docs", "ids", "nulls", "doc_ids", "sizes", "body"])

        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            for first, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                flat, sizes = tok.encode(data, offsets)
                last = np.cumsum(sizes + 1)
                ids = np.full(len(flat) + len(sizes), end_id, dtype=tok.kind)
                inner = np.ones(len(ids), dtype=bool)
                inner[last - 1] = False
                ids[inner] = flat
                row = 0
                while row < len(sizes):
                    before = int(last[row - 1]) if row else 0
                    end = min(len(sizes), int(np.searchsorted(last, before + SEGMENT_IDS - count)) + 1)
                    held.append((null[first + row : first + end], doc_ids[first + row : first + end], sizes[row:end] + 1, ids[before : last[end - 1]]))
                    count += int(last[end - 1]) - before
                    row = end
                    if count >= SEGMENT_IDS:
                        yield close()
        if held:
            yield close()

    return run


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                c = np.bincount(np.frombuffer(body, dtype=kind))
                if len(c) > len(total):
                    total, c = c, total
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return run


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``limit`` bits, by package-merge; 0 for unused ids."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n == 1:
        lengths[used] = 1
    if n < 2:
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, leaves = weights, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        by = np.argsort(both, kind="stable")
        level = both[by]
        leaves.append(by < n)
    take = 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bit offset of each block, bits)."""
    n = lengths[ids]
    at = np.cumsum(n) - n
    total = int(n.sum())
    word, off = at >> 6, (at & 63).astype(np.uint64)
    code = (codes << ((64 - lengths) & 63).astype(np.uint64))[ids]  # aligned to the left, once for each id there is
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros((total >> 6) + 2, dtype=np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(code >> off, first)
    over = np.flatnonzero((off > 0) & (off.astype(np.int64) + n > 64))
    words[word[over] + 1] |= code[over] << (np.uint64(64) - off[over])
    return at[::BLOCK_IDS].astype("<u8"), words.astype(">u8").tobytes()[: (total + 7) // 8]


def decode_table(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each value of the next ``bits`` bits."""
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (np.uint64(bits) - lengths[used].astype(np.uint64)))]
    span = 1 << (bits - lengths[used])
    ids, n = np.repeat(used, span).astype(np.uint32), np.repeat(lengths[used], span).astype(np.uint8)
    short = (1 << bits) - len(ids)  # a single id leaves half of the values unused
    return np.append(ids, np.zeros(short, dtype=np.uint32)), np.append(n, np.ones(short, dtype=np.uint8))


def unpack(bits: bytes, offsets: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """The ``count`` ids of a segment, all blocks in lock step."""
    raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    ids, lengths = table
    blocks = len(offsets)
    out = np.zeros((BLOCK_IDS, blocks), dtype=np.uint32)
    at = offsets.astype(np.int64)
    last = count - (blocks - 1) * BLOCK_IDS
    for step in range(min(BLOCK_IDS, count)):
        if step == last and blocks > 1:
            at = at[:-1]
        value = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[step, : len(at)] = ids[value]
        at = at + lengths[value]
    return out.T.ravel()[:count]


def _compress(lengths, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = lengths.value
        codes = canonical_codes(n)
        for batch in batches:
            data = []
            for nulls, doc_ids, sizes, body in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7)), strict=True):
                ids = np.frombuffer(body, dtype=kind)
                offsets, bits = pack(ids, n, codes)
                head = np.array([len(sizes) // 4, len(offsets), nulls], dtype="<u4").tobytes()
                data.append(MAGIC + head + doc_ids + sizes + offsets.tobytes() + bits)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(data, pa.binary())], names=["part", "seq", "docs", "ids", "data"])

    return run


def write_id_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Encode the texts of ``docs``, append ``end_id`` to each, and write segments and code lengths under ``path``.

    Null text is empty and has the end id alone.  Rows go by doc_id, a null id
    first (it reads back as null); repeated rows are documents of their own.  An empty table writes no
    segments.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = texts.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    kind = ChunkTokenizer(tokenizer_file).kind
    raw = materialize(ranged.mapInArrow(_segments(tokenizer_file, end_id), _SEGMENT))
    counts = raw.select("body").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(max(counts.column(0).to_pylist(), default=-1) + 1, dtype=np.int64)  # as many as the vocabulary has ids
    total[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    lengths = code_lengths(total)
    spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths) if n], "id long, bits long").coalesce(1).write.parquet(f"{path}/lengths")
    sent = spark.sparkContext.broadcast(lengths)
    raw.mapInArrow(_compress(sent, kind), "part long, seq long, docs long, ids long, data binary").write.parquet(f"{path}/segments")
    discard(raw)


def _expand(table, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(table.value, width)
        for batch in batches:
            for start, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start", "data")), strict=True):
                if data[:4] != MAGIC:
                    raise ValueError("not a segment of ids")
                docs, blocks, nulls = np.frombuffer(data, dtype="<u4", count=3, offset=4).tolist()
                at = 16
                doc_ids = np.frombuffer(data, dtype="<i8", count=docs, offset=at)
                sizes = np.frombuffer(data, dtype="<u4", count=docs, offset=(at := at + 8 * docs)).astype(np.int64)
                offsets = np.frombuffer(data, dtype="<u8", count=blocks, offset=(at := at + 4 * docs))
                flat = unpack(data[at + 8 * blocks :], offsets, int(sizes.sum()), lookup, width).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                null = np.arange(docs) < nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=null), pa.array(start + ends - sizes), pa.array(sizes), pa.array([flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files that :func:`write_id_files` wrote; ids are little-endian u32, ``start`` counts the ids before."""
    found = spark.read.parquet(f"{path}/lengths").toArrow()
    lengths = np.zeros(max(found.column(0).to_pylist(), default=-1) + 1, dtype=np.int64)
    lengths[found.column(0).to_numpy()] = found.column(1).to_numpy()
    segments = spark.read.parquet(f"{path}/segments")
    parts = segments.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect()  # a row per partition of the writer
    before = np.cumsum([0, *(r["n"] for r in parts)]).tolist()
    offsets = spark.createDataFrame([(r["part"], b) for r, b in zip(parts, before[:-1], strict=True)], "part long, before long")
    own = segments.select("part", "seq", "ids").withColumn("inside", F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids"))
    starts = materialize(own.join(offsets, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start")))  # small: Spark sees its size
    placed = segments.join(starts, ["part", "seq"]).select("start", "data")
    return placed.mapInArrow(_expand(spark.sparkContext.broadcast(lengths), MAX_BITS), "doc_id long, start long, n_tokens long, ids binary")


def id_checksums(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


