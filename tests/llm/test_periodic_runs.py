import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from waymark.llm.periodic_runs import periodic_runs, run_digests, with_planted_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs string, best string, collapsed string, _w string"


def brute(words, least=24, turns=3):
    """All runs by comparing the text with itself shifted by every q."""
    n, found = len(words), {}
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, turns * q):
                found.setdefault((i, length), q)  # the least q comes first
            i = j + 1
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def digest(words, runs):
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    line = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(line), sha(kept))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def texts():
    rng = np.random.default_rng(1)
    out = [None, "", " \n\t", "one", "x " * 23, "x " * 24, "a b " * 12, "a b c " * 7 + "a b", "A a " * 40, "é b c " * 30]
    for size in (2, 2, 3, 4):
        out += [" ".join(rng.choice([f"w{i}" for i in range(size)], n)) for n in (30, 200, 700)]
    for _ in range(25):
        parts = []
        for _ in range(rng.integers(1, 6)):
            unit = rng.choice([f"v{i}" for i in range(4)], rng.integers(1, 40)).tolist()
            parts += unit * int(rng.integers(1, 9)) + unit[: rng.integers(0, len(unit) + 1)]
        out.append("  ".join(parts) + "\n")
    unit = [f"u{i}" for i in range(50)]
    out.append(" ".join((unit * 4 + ["stop"]) * 6))  # runs of runs, and the passage far apart
    out.append(" ".join(rng.choice([f"n{i}" for i in range(3000)], 4000)))
    return out


def test_op13_against_brute_force(spark):
    rows = [(i, t, "x", "x", "x", "x") for i, t in enumerate(texts())]
    rows += [(None, "k " * 90, "x", "x", "x", "x"), (5, "again " * 70, "x", "x", "x", "x"), (5, None, "x", "x", "x", "x")]
    rows += [(100 + i, rows[11 + i % 30][1], "x", "x", "x", "x") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, run_digests(periodic_runs(with_planted_runs(df))).collect()), key=repr)
    want = [(r[0], *digest(words, brute(words))) for r in rows for words in [planted(r[0], r[1])]]
    assert got == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 30 and max(w[1] for w in want) > 3
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows)


def test_op13_other_limits(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    for least, turns in ((4, 2), (7, 2), (9, 4), (1, 3)):
        for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), least, turns).collect():
            words = WORD.findall(rows[r.doc_id][1] or "")
            assert [tuple(x) for x in r.runs] == brute(words, least, turns), (least, turns, r.doc_id)
            assert r.n_words == len(words)


def test_op13_long_texts_and_empty_table(spark):
    assert run_digests(periodic_runs(spark.createDataFrame([], SCHEMA))).count() == 0
    unit = " ".join(f"w{i}" for i in range(997))
    df = spark.createDataFrame([(1, "long " * 200_000), (2, (unit + " ") * 150 + "end"), (3, "x" * 3_000_000), (4, ("a " * 30 + "b ") * 3000)], "doc_id int, text string")
    got = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 200_000, 1)] and got[1].collapsed == "long"
    assert [tuple(x) for x in got[2].runs] == [(0, 997 * 150, 997)] and got[2].collapsed == unit + " end"
    assert not got[3].runs and got[3].best is None
    assert len(got[4].runs) == 3001 and tuple(got[4].best) == (0, 93_000, 31)
    assert periodic_runs(df).select(F.sum("n_words")).first()[0] == 200_000 + 997 * 150 + 1 + 1 + 93_000


def test_op13_query_keeps_every_row(spark, tmp_path):
    from waymark.llm.queries import QUERIES

    rows = [(i, "a b c " * (i + 1)) for i in range(60)] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [(r[0], *digest(words, brute(words))) for r in rows for words in [planted(r[0], r[1])]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
