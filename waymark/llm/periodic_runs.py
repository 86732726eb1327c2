"""Periodic runs of words, by the maximal pairs of a document.

A maximal pair is two places i < j that go on alike for l words, but neither
with the word before nor with the word after.  The words from i to j + l then
have period q = j - i and no neighbour keeps it, so a pair whose distance is
small enough against l *is* a run: nothing has to be extended or checked.

Pairs come from the tree of LCP intervals, walked bottom-up over the suffix
array.  An interval of depth l holds its places in lists by the word before
them; when two parts of an interval meet, places of lists with different words
within the allowed distance are maximal pairs of length l.  The smaller part is
merged into the larger.

Only repetitive stretches get a suffix array.  A run of at least ``least``
words and ``turns`` periods has l >= least * (turns - 1) / turns =: w, so its
places start w-grams that the document repeats; both ends of a pair lie in one
chain of such places with gaps of at most w (between the places i .. i + l - w
and j there are q - (l - w) <= w words).  Each chain is a string of its own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, text_chunks, words
from .shared import WORD

RUNS = "array<struct<start: long, length: long, period: long>>"


def _grams(h: np.ndarray, w: int) -> np.ndarray:
    """A hash of the ``w`` words from each place on, by doubling."""
    out, have, size, step = np.zeros(max(0, len(h) - w + 1), dtype=np.uint64), h, 1, 0
    while size <= w:
        if w & size:
            out = mix(out ^ have[step : step + len(out)])
            step += size
        if size * 2 <= w:
            have = mix(mix(have[: len(have) - size]) + have[size:])
        size *= 2
    return out


def _chains(h: np.ndarray, doc: np.ndarray, ends: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word place (the word that may end a match included) of each chain of repeated w-grams."""
    gram = _grams(h, w)
    place = np.flatnonzero(np.arange(len(gram)) + w <= ends[doc[: len(gram)]])
    with np.errstate(over="ignore"):
        key = mix(gram[place] + mix(doc[place].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = place[again]
    if not len(at):
        return at, at
    new = np.concatenate(([True], (np.diff(at) > w) | (doc[at[1:]] != doc[at[:-1]])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], np.minimum(at[last] + w, ends[doc[at[last]]] - 1)


def _suffixes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes within their chain, and how many words each shares with the one before.

    Prefix doubling over all chains at once; an end mark of its own closes each chain.
    """
    size = hi - lo + 2
    first = np.cumsum(size) - size
    chain = np.repeat(np.arange(len(lo)), size)
    place = np.arange(int(size.sum())) - first[chain] + lo[chain]
    mark = place > hi[chain]
    word = np.unique(h[np.minimum(place, len(h) - 1)], return_inverse=True)[1]
    n = len(place)
    rank = np.unique(chain * (n + 1) + np.where(mark, n, word), return_inverse=True)[1]
    levels, step = [rank], 1
    while rank.max(initial=-1) < n - 1 and step < n:
        ahead = np.full(n, -1)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1]
        levels.append(rank)
        step *= 2
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(0, n - 1), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = level[a[inside]] == level[b[inside]]
        a[same] += 1 << k
        b[same] += 1 << k
        shared[same] += 1 << k
    return place[order], np.concatenate(([0], shared)) if n else shared


def _meet(a: dict, b: dict, depth: int, turns: int, least: int, found: dict) -> None:
    """Maximal pairs between two parts of an interval: (start, length) -> least period."""
    reach = depth // (turns - 1)
    for left, mine in a.items():
        for other, theirs in b.items():
            if left == other:
                continue
            few, many = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
            for x in few:
                for k in range(bisect_left(many, x - reach), bisect_right(many, x + reach)):
                    y = many[k]
                    q = abs(x - y)
                    if q + depth >= least:
                        run = (min(x, y), q + depth)
                        if found.get(run, q) >= q:
                            found[run] = q


def _merge(a: dict, b: dict) -> dict:
    """The class lists of both parts; the smaller part moves."""
    if sum(map(len, a.values())) < sum(map(len, b.values())) if len(a) + len(b) < 8 else len(a) < len(b):
        a, b = b, a
    for left, places in b.items():
        have = a.get(left)
        if have is None:
            a[left] = places
        elif have[-1] < places[0]:
            have.extend(places)
        else:
            if len(have) < len(places):
                have, places = places, have
                a[left] = have
            for x in places:
                insort(have, x)
    return a


def _runs(h: np.ndarray, per_row: np.ndarray, least: int, turns: int) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> its runs (start, length, period), by start and period; rows without runs are left out."""
    ends = np.cumsum(per_row)
    doc = np.repeat(np.arange(len(per_row)), per_row)
    w = -(-least * (turns - 1) // turns)
    if len(h) < w:
        return {}
    lo, hi = _chains(h, doc, ends, w)
    if not len(lo):
        return {}
    places, shared = _suffixes(h, lo, hi)
    begins = ends - per_row
    lefts = np.where(places == begins[doc[np.minimum(places, len(doc) - 1)]], -1 - places, np.unique(h, return_inverse=True)[1][places - 1])
    useful = np.flatnonzero((shared >= w) | np.append(shared[1:] >= w, False))  # others have no partner
    found: dict[tuple[int, int], int] = {}
    stack: list[list] = []
    node: dict = {}
    shared = np.where(shared >= w, shared, 0)[useful]
    for place, left, depth in zip(places[useful].tolist(), lefts[useful].tolist(), shared.tolist(), strict=True):
        while stack and stack[-1][0] > depth:
            at, before = stack.pop()
            _meet(before, node, at, turns, least, found)
            node = _merge(before, node)
        if depth:
            if stack and stack[-1][0] == depth:
                _meet(stack[-1][1], node, depth, turns, least, found)
                stack[-1][1] = _merge(stack[-1][1], node)
            else:
                stack.append([depth, node])
        node = {left: [place]}
    while stack:
        at, before = stack.pop()
        _meet(before, node, at, turns, least, found)
        node = _merge(before, node)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (start, length), q in sorted((run, q) for run, q in found.items()):
        row = int(doc[start])
        out.setdefault(row, []).append((start - int(begins[row]), length, q))
    for runs in out.values():
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for r in runs[1:]:  # in order of start and period, so only a larger ratio replaces it
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _collapse(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The words that are in no run after its first period, joined by one space."""
    parts = text.encode().split()  # bytes are split at exactly [\x20\x09-\x0D]
    step = np.zeros(len(parts) + 1, dtype=np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()
    return b" ".join(map(parts.__getitem__, keep)).decode()


RUN_TYPE = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def _scan(least: int, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for first, data, offsets in text_chunks(texts):
                h, per_row = words(data, offsets, fold=False)
                found = _runs(h, per_row, least, turns)
                n = len(per_row)
                runs, best, kept = [], [], []
                for i, text in enumerate(texts.slice(first, n).to_pylist()):
                    mine = found.get(i, [])
                    runs.append([{"start": s, "length": k, "period": q} for s, k, q in mine])
                    best.append(dict(zip(("start", "length", "period"), _strongest(mine), strict=True)) if mine else None)
                    kept.append(_collapse(text, mine) if mine else b" ".join((text or "").encode().split()).decode())
                columns = [batch.column(0).slice(first, n), pa.array(per_row), pa.array(runs, pa.list_(RUN_TYPE)), pa.array(best, RUN_TYPE), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 24, turns: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed), one row per row of ``docs``.

    ``runs`` holds every stretch of words with smallest period q and at least
    max(``least``, ``turns`` * q) words that no neighbouring word extends, by
    start and then period; ``best`` is the one with the greatest length /
    period (then the smallest start and period; null without runs);
    ``collapsed`` is the text without the words that any run contains after its
    first q words, joined by single spaces.  ``turns`` is 2 or more.  Words are
    ``[^\\x20\\x09-\\x0D]+`` as they stand, compared by 64-bit hashes.

    Null and empty texts have no words and no runs.  Rows that repeat or have
    no id are rows of their own.  An empty table gives no rows; other columns
    are ignored.  A row is handled by itself, so no row is moved; memory follows
    the longest text (about 200 bytes a word of its repetitive stretches).
    """
    if turns < 2 or least < 1:
        raise ValueError("turns is 2 or more, least 1 or more")
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, best {RUNS[6:-1]}, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_scan(least, turns), out)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of one document in ten go round from some word on; fixed by the crc32 of the id.

    With h = crc32 of the decimal id, g = h div 10 and n words: where h % 10 = 0
    and n > 0, each word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words_of = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    hit = (h % 10 == 0) & F.col("text").rlike(WORD)
    g, n = F.expr("_h div 10"), F.size("_w")
    rows = docs.select(F.col("doc_id"), F.col("text"), h.alias("_h"), F.when(hit, words_of).alias("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_w").isNotNull(), (g % n)).cast("int"))
    rows = rows.withColumn("_p", F.expr("cast(1 + (size(_w) - _a) div (3 + (_h div 10) % 8) as int)"))
    cycle = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.expr("cast((size(_w) - _a) div _p + 1 as int)")))
    made = F.array_join(F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), cycle), F.lit(1), n), " ")
    return rows.select("doc_id", F.when(F.col("_w").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row per document with its strongest run and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
