"""Whole-batch hashing of words and word shingles with numpy.

A batch of texts is one byte buffer; words of every text are hashed at once by
a polynomial over their bytes, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = np.random.default_rng(20240102).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for name, base in (("up", _P), ("down", pow(_P, -1, 2**64))):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``size`` bytes of text; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z lower-cased if ``fold``, and the number of words of each row; ``gaps`` are the bytes between words."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
    up, down = _powers(len(data))
    space = gaps[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    value = _BYTE[_LOWER[data] if fold else data]
    value *= up[: len(data)]
    value[space] = 0
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
    h = np.add.reduceat(value, starts) * down[starts]
    per_row = np.diff(np.searchsorted(starts, offsets))
    return mix(h), per_row


def shingles(hashes: np.ndarray, per_row: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct shingles of ``size`` words; a shorter text is one shingle, none without words."""
    ends = np.cumsum(per_row)
    n = len(hashes)
    windows = max(0, n - size + 1)  # none in a chunk of fewer words
    run = np.zeros(windows, dtype=np.uint64)
    for j in range(size):
        run += hashes[j : j + windows] * _STEP[j]
    run = mix(run + _U(size))
    out = []
    for end, count in zip(ends.tolist(), per_row.tolist(), strict=True):
        if count >= size:
            s = np.sort(run[end - count : end - size + 1])
            if len(s) > 1:
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif count:
            s = mix(np.array([(hashes[end - count : end] * _STEP[:count]).sum() + _U(count)], dtype=np.uint64))
        else:
            s = np.zeros(0, dtype=np.uint64)
        out.append(s)
    return out


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) for every row of a text column."""
    for first, data, offsets in text_chunks(column):
        yield from enumerate(shingles(*words(data, offsets), size), first)


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        total = mix(s ^ _U(0x5851F42D4C957F2D)).sum() + _U(len(s))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])
