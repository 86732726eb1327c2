"""The pipeline's stages against a brute-force version on a small fixture, and the queries that have SQL."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from waymark.llm import queries
from waymark.llm.mixing import mix_sources
from waymark.llm.piece_bpe import AgendaEncoder
from waymark.llm.shared import materialize
from waymark.llm.tokenizer_files import tokenizer_path

from .test_operators import WORD, after_lines, after_quality, corpus, linked

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus(spark).select(*corpus_pipeline.COLUMNS)
    told = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, ""))
        told[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = told["n-gram Jaccard join"]
    want = linked([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c, _) in want.items() if i == c}
    before, after = told["quality rules"]
    want = after_quality([(r.doc_id, r.text, r.source) for r in before.collect()])
    assert len(want) > 10 and Counter((r.doc_id, r.text) for r in after.collect()) == Counter(want)
    before, after = told["line dedup"]
    want = [(i, t) for i, _, _, t in after_lines([(r.doc_id, r.text) for r in before.collect()])]
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter(want)
    before, after = told["mixing sources to target weights"]
    words, taken = Counter(), Counter()
    known = {(r.doc_id, r.text) for r in before.collect()}
    for r in before.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    for r in after.collect():
        assert (r.doc_id, r.text) in known
        taken[r.source] += len(WORD.findall(r.text or ""))
    longest = max(len(WORD.findall(t or "")) for _, t in known)
    target = {r.source: r.target for r in mix_sources(before).collect()}
    assert abs(sum(target.values()) - sum(words.values())) < 1e-6 and all(abs(taken[s] - target[s]) <= longest for s in words)
    before, after = told["SentencePiece encoding and decoding"]
    library = AgendaEncoder(tokenizer_path("piece_bpe_32k.model")).library
    ids = [(r.doc_id, library.encode(r.text or "", add_bos=True, add_eos=True)) for r in before.collect()]
    want = [(i, len(x), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, x in ids]
    assert want and Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()) == Counter(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, cur.fetchall()))
