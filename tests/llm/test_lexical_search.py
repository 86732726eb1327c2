import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from waymark.llm import lexical_search as module
from waymark.llm.lexical_search import lexical_search
from waymark.llm.queries import QUERIES, SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, score string, rank string, path string, m string, terms string"
ITEMS = "item_id string, text string, n string, item string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in wanted if t in b)
            if s > 0:
                scored.append((-s, i if i is not None else -(2**63), i))
        out += [(item, n, i, -s) for n, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=50):
    d = spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in docs], DOCS)
    found = lexical_search(d, spark.createDataFrame([(i, t, "x", "x") for i, t in items], ITEMS), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "éa", "漢字", "9", "x_y", "it's"]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30), p=share / share.sum()))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [(n + 50 + i, docs[i % 7][1].upper()) for i in range(30)]
    docs += [(5, docs[0][1]), (5, docs[0][1]), (None, docs[1][1]), (None, docs[3][1]), (9000, None), (9001, ""), (9002, " .,-\n"), (9003, "w0 " * 20_000), (9004, "\x7f\x80 w1\x00w2")]
    return docs, vocabulary


def test_op11_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAF_DOCS", 3)
    monkeypatch.setattr(module, "TRIE_DOCS", 150)
    monkeypatch.setattr(module, "SAMPLE_DOCS", 60)
    rng = np.random.default_rng(4)
    docs, vocabulary = corpus(rng, 500)
    items = [(f"i{i}", " ".join(rng.choice(vocabulary, rng.integers(1, 12)))) for i in range(25)]
    items += [("copy", docs[3][1]), ("i0", "w1 extra"), (None, "w2"), ("null", None), ("none", "!?"), ("never", "zebra"), ("all", "w0 W0")]
    for k in (50, 4):
        assert run(spark, docs, items, k) == brute(docs, items, k)
    monkeypatch.setattr(module, "ITEMS_AT_ONCE", 9)  # several blocks of items
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_op11_prunes(spark):
    rng = np.random.default_rng(5)
    rows = sorted((np.unique(np.concatenate(([i % 5], rng.integers(5, 3000, 6)))).astype(">i4").tobytes(), b"\1\0\0\0" * 7) for i in range(4000))
    rows = [(p, t[: len(p)]) for p, t in rows]
    trie = module.Trie([p for p, _ in rows], [t for _, t in rows], np.full(4000, 100), np.arange(4000))
    opened = []
    weight = np.zeros(3000, dtype=np.int64)
    weight[np.frombuffer(rows[77][0], dtype=">i4")] = 5000
    best = module.Best(3, 1)
    take = best.take
    best.take = lambda s, i: (opened.append(len(s)), take(s, i))
    trie.search(weight, best)
    assert best.ids[0] == 77 and sum(opened) < 1000


def test_op11_empty_tables(spark):
    docs, items = [(1, "a b")], [("x", "a")]
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == []
    assert [r[:3] for r in run(spark, docs, items)] == [("x", 1, 1)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op11_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = QUERIES["op11_lexical_search"](spark, f"/root/testdata/{sf}")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(SQL["op11_lexical_search"]).fetchall())
