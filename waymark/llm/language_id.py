"""Language identification with error-correcting output codes.

Each language has a codeword of bits; a binary classifier per bit, on hashed
byte trigrams, tells on which side of the bit a text is.  The classifiers are
naive Bayes: their weights come from trigram counts of a bounded sample of
labelled rows.  Decoding weighs each bit's loss by how well that bit did on
that language in the sample, takes the codeword of least loss, and flags a text
whose two best codewords are close.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import text_chunks

BUCKETS = 1 << 15
#: Labelled rows of each language that are learned from, about; fewer if there are fewer.
SAMPLE_ROWS = 4000
#: Partitions that count the sample; their counts are summed by language before they go to the driver.
COUNTERS = 8
MOST_LANGUAGES = 500
UNKNOWN = "und"
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages: all splits up to five of them, else the best of random codes."""
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.float64).T.reshape(n, -1)
    rng = np.random.default_rng(seed)
    bits = max(12, int(4 * np.ceil(np.log2(n))))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), size=(n, bits))
        code[:, np.abs(code.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        near = int(((bits - code @ code.T) / 2 + bits * np.eye(n)).min())
        if near > far:
            best, far = code, near
    return best


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte's trigram, start of each row); a row of n bytes has n trigrams, padded with spaces."""
    b = np.concatenate((np.array([32], dtype=np.uint32), _FOLD[data], np.array([32], dtype=np.uint32)))
    left, mid, right = b[:-2].copy(), b[1:-1], b[2:].copy()
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    left[inner] = 32
    right[inner - 1] = 32
    h = (left * np.uint32(0x9E3779B1)) ^ (mid * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int64), offsets[:-1]


def _margins(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean weight of a row's trigrams, for each bit; 0 for empty rows."""
    out = np.zeros((len(column), weights.shape[1]))
    for first, data, offsets in text_chunks(column):
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        if not len(full):
            continue
        at, start = trigrams(data, offsets)
        sums = np.add.reduceat(weights[at], start[full], axis=0)
        out[first + full] = sums / size[full, None]
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _count(langs: list[str]):
    """(lang, buckets, counts): the trigrams that a task's rows of a language have, without empty buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = {x: i for i, x in enumerate(langs)}, [], 0
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for first, data, offsets in text_chunks(batch.column(0)):
                if not len(data):
                    continue
                at, _ = trigrams(data, offsets)
                own = np.repeat(lang[first : first + len(offsets) - 1], np.diff(offsets))
                parts.append(np.unique(own * BUCKETS + at, return_counts=True))
                size += len(parts[-1][0])
                if size > 1 << 21:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
        if parts:
            yield from _rows_of(*_summed(parts))

    return run


def _rows_of(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    edges = np.searchsorted(keys, np.arange(0, keys[-1] // BUCKETS + 2) * BUCKETS)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        at = slice(edges[k], edges[k + 1])
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([(keys[at] % BUCKETS).astype("<i4").tobytes()], pa.binary()), pa.array([counts[at].astype("<i8").tobytes()], pa.binary())], names=["lang", "buckets", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language, from its rows of all tasks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, buckets, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total.setdefault(k, np.zeros(BUCKETS, dtype=np.int64))[np.frombuffer(buckets, dtype="<i4")] += np.frombuffer(counts, dtype="<i8")
    for k, x in total.items():
        some = np.flatnonzero(x)
        yield from _rows_of(some + k * BUCKETS, x[some])


def _bit_hits(langs: list[str], weights, code: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hits, rows = {x: i for i, x in enumerate(langs)}, np.zeros(code.shape), np.zeros(len(langs))
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            right = _margins(batch.column(0), weights.value) * code[lang] > 0
            np.add.at(hits, lang, right)
            np.add.at(rows, lang, 1)
        yield pa.RecordBatch.from_arrays([pa.array([hits.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], names=["hits", "rows"])

    return run


def bit_weights(counts: np.ndarray, code: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log-odds of each bucket for each bit; languages weigh alike, whatever their number of rows."""
    share = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True)
    out = np.empty((counts.shape[1], code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        out[:, b] = np.log(share[code[:, b] > 0].mean(axis=0) / share[code[:, b] < 0].mean(axis=0))
    return out


def decode(margins: np.ndarray, code: np.ndarray, trust: np.ndarray, steep: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best codeword, score, gap to the second) by the weighted loss log(1 + exp(-steep * margin * bit))."""
    loss = np.stack([(np.logaddexp(0, -steep * margins * code[k]) * trust[k]).sum(axis=1) for k in range(len(code))], axis=1)
    best = loss.argmin(axis=1)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * code.shape[1])
    ordered = np.sort(loss, axis=1)
    gap = ordered[:, 1] - ordered[:, 0] if len(code) > 1 else np.full(len(loss), np.inf)
    return best, 1 / p.sum(axis=1), gap


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _predict(langs: list[str], weights, code: np.ndarray, trust: np.ndarray, ambiguous_below: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            told = np.array([_has_letter(t) for t in text.to_pylist()], dtype=bool)
            if not langs:
                told[:] = False
            if len(langs) > 1:
                best, score, gap = decode(_margins(text, weights.value), code, trust)
            else:
                best, score, gap = np.zeros(len(text), dtype=np.int64), np.ones(len(text)), np.full(len(text), np.inf)
            names = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), told.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.where(told, score, 0.0)), pa.array(told & (gap < ambiguous_below))],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify_language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, ambiguous_below: float = 0.05) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per row of ``docs``.

    Rows whose crc32 of doc_id as text leaves 1 modulo 3 are held out; the
    others with a language, about ``sample_rows`` of each, are learned from.
    More than MOST_LANGUAGES languages are an error.
    Only the text decides a prediction.  Texts that are null or without a
    letter are ``und`` with score 0, as all are if nothing could be learned.
    Repeated rows give equal rows; a null doc_id counts as empty text in the
    fold; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold == 1).alias("held_out"), F.col("lang").cast("string").alias("lang"))
    known = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(sizes)
    code = codewords(len(langs)) if langs else np.zeros((0, 0))
    trust, weights = np.ones(code.shape), None
    if len(langs) > 1:
        share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
        part = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample_rows / sizes[x]))) for x in langs])
        sample = known.where(share < part).select("text", "lang").repartition(COUNTERS, F.xxhash64("doc_id", "text"))
        schema, counts = "lang long, buckets binary, counts binary", np.zeros((len(langs), BUCKETS))
        for r in sample.mapInArrow(_count(langs), schema).repartition(COUNTERS, "lang").mapInArrow(_add_up, schema).toLocalIterator():  # a row per language
            counts[r["lang"], np.frombuffer(r["buckets"], dtype="<i4")] = np.frombuffer(r["counts"], dtype="<i8")
        weights = spark.sparkContext.broadcast(bit_weights(counts, code))
        got = sample.mapInArrow(_bit_hits(langs, weights, code), "hits binary, rows binary").collect()
        hits = sum(np.frombuffer(r["hits"]) for r in got).reshape(code.shape)
        seen = sum(np.frombuffer(r["rows"]) for r in got)
        trust = (hits + 1) / (seen[:, None] + 2)
        trust = trust / trust.sum(axis=1, keepdims=True)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(langs, weights, code, trust, ambiguous_below), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")
