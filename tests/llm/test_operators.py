import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import chat_format, huffman_ids, license_scan
from waymark.llm.language_id import codewords, identify_language
from waymark.llm.line_dedup import line_dedup
from waymark.llm.mixing import mix_sources, take_mix
from waymark.llm.neighbours import nearest
from waymark.llm.ngram_join import keep_one_per_component, ngram_jaccard_join
from waymark.llm.piece_bpe import AgendaEncoder, encode_decode, id_digests
from waymark.llm.quality_rules import quality_rules
from waymark.llm.tokenizer_files import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, ids string, own_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab, n)) for n in (5, 12, 60, 90, 200, 700)]
    shared = "this very common line stands in many documents"
    rows = []
    for b in base:
        for copy in range(6):
            words = b.split(" ")
            for at in rng.integers(0, len(words), copy // 2):
                words[at] = "changed"
            rows.append("\n".join([" ".join(words[: len(words) // 2]), "  " + shared.upper(), " ".join(words[len(words) // 2 :])]))
    rows += [rows[-1], rows[-1], None, "", " \t\n ", "one", "ÄÖ Ü é ß", "!!! 123", "long " * 30_000, shared, "a\n" + shared]
    out = [(i, t, ["en", None, "de"][i % 3], [None, "b", "a", ""][i % 4], 1, "x", "x", "x", "x") for i, t in enumerate(rows)]
    out.append((None, None, None, None, None, None, None, None, None))
    out.append(out[3])
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    """Brute force over (id, text): id -> (set size, least id reached, number of links)."""
    sets = {i: shingles(t) for i, t in rows}
    up, links = {i: i for i in sets}, Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                links.update((a, b))
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def test_op1_links(docs, empty):
    rows = docs.where("doc_id IS NOT NULL").distinct()
    want = linked([(r.doc_id, r.text) for r in rows.collect()])
    got = {r.doc_id: r for r in ngram_jaccard_join(rows).collect()}
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in got.items()} == want
    assert any(r.component_id != r.doc_id for r in got.values())
    every = ngram_jaccard_join(docs).collect()
    assert len(every) == docs.count() and all((r.n_shingles, r.component_id) == want[r.doc_id][:2] for r in every if r.doc_id is not None)
    assert {r.n_links for r in every if r.doc_id == 3} == {want[3][2] + 1}  # its copy is a row more
    assert ngram_jaccard_join(empty).count() == 0


def test_op1_keeps_one_row_as_it_is(docs, empty):
    want = linked([(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").distinct().collect()])
    clash = docs.selectExpr("doc_id", "text", "'a' AS copy", "'b' AS own_id", "'c' AS nth", "'d' AS h", "'e' AS did", "'f' AS row", "n_chars AS sid")
    got = keep_one_per_component(clash).collect()
    assert {r.doc_id for r in got} == {i for i, w in want.items() if i == w[1]} | {None}
    assert len(got) == len({(r.doc_id, r.text) for r in got})
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r[1:8] == (texts[r.doc_id], *"abcdef"[:6]) for r in got)
    assert keep_one_per_component(empty).count() == 0


def test_op1_chunks_of_few_words(spark):
    rows = [(n, " ".join("abcdefg"[:n])) for n in range(8)] + [(8, "eight words stand in this text at last"), (9, "A B C")]
    one_each = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(10, "doc_id")
    assert one_each.select(F.spark_partition_id()).distinct().count() > 5
    assert {r.doc_id: tuple(r)[1:] for r in ngram_jaccard_join(one_each).collect()} == linked(rows)


def test_op1_null_ids_take_part(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(x) for x in (words, ["front"] * 5 + words[5:], ["front"] * 5 + words[5:55] + ["end"] * 5)]
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[1]), (3, chain[2]), (None, "quite another text of no one " * 3)]
    assert linked(list(enumerate(chain)))[2][1] == 0 and linked([(0, chain[0]), (2, chain[2])])[2][1] == 2
    got = sorted(ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.n_links) for r in got if r.doc_id] == [(1, 1, 2), (3, 1, 2)]
    assert sorted((r.component_id or 0, r.n_links) for r in got if r.doc_id is None) == [(0, 0), (1, 3), (1, 3)]


def test_op1_groups_of_many_blocks(spark, monkeypatch):
    from waymark.llm import ngram_join as module

    monkeypatch.setattr(module, "BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = []
    for base in range(3):
        words = rng.choice([f"v{i}" for i in range(5000)], 150).tolist()
        for _ in range(40):
            own = list(words)
            for at in rng.integers(0, 150, rng.integers(0, 5)):
                own[at] = f"z{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(own)))
    want = linked(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in ngram_jaccard_join(df).collect()} == want
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(df, count_links=False).collect()} == {i: w[1] for i, w in want.items()}
    assert {r.doc_id for r in keep_one_per_component(df).collect()} == {i for i, w in want.items() if w[1] == i}


def test_op2_mix(docs, empty):
    rows = docs.where("doc_id IS NOT NULL")
    mix = mix_sources(rows)
    got = mix.collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 3
        size[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(target[s] <= 3 * size[s] + 1e-9 for s in size)
    longest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    assert Counter(mix_sources(rows.repartition(3)).collect()) == Counter(got)
    taken_rows = Counter((r.doc_id, r.text) for r in take_mix(rows, mix).collect())
    by_id = Counter()
    for r in got:
        by_id[r.doc_id] += r.copies
    assert sum(taken_rows.values()) == sum(by_id.values()) and all(sum(n for (i, _), n in taken_rows.items() if i == d) == c for d, c in by_id.items())
    assert take_mix(empty, mix).count() == 0 and take_mix(docs, mix_sources(docs)).count() > 0
    assert mix_sources(empty).count() == 0


def test_op2_targets_follow_weights(spark):
    from waymark.llm.mixing import source_targets

    s = spark.createDataFrame([("a", 1000, 10), ("b", 10, 1), ("c", 500, 5), (None, 100, 2)], "source string, source_size long, n long")
    t = {r.source: r.target for r in source_targets(s).collect()}
    # weights 5, 2, 1, 5; b stops at 30 and the null source at 300, and their excess goes to a and c by 5 to 1
    assert t["b"] == 30 and t[None] == 300 and abs(t["a"] - 1280 * 5 / 6) < 1e-9 and abs(t["c"] - 1280 / 6) < 1e-9


def test_op2_targets_against_brute_force(spark):
    from waymark.llm.mixing import source_targets

    rng = np.random.default_rng(6)
    sizes = [(f"s{i:02}", int(n)) for i, n in enumerate(rng.zipf(1.3, 30) % 100_000)] + [(None, 77)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n long")).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
    want, left, open_ = {}, float(sum(n for _, n in sizes)), dict(sizes)
    while True:  # those above their cap stop there, and the excess is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * open_[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * open_[s]
            left -= want[s]
            del open_[s]
    want |= share
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_op2_flight_is_balanced_and_unbiased():
    from waymark.llm.mixing import _fly, _land

    rng = np.random.default_rng(9)
    pi, size = rng.random(40), rng.integers(0, 500, 40).astype(float)
    total = np.zeros(40)
    for seed in range(4000):
        out = _fly(pi, size, np.random.default_rng(seed))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-3
        total += out
        landed = _land(out, size)
        assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (pi * size).sum()) <= 500
    assert np.abs(total / 4000 - pi).max() < 0.04


def test_op3_licences(spark, docs, empty):
    texts = [
        "x y.\nReleased under the MIT License.\nmore",
        "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of it. The above copyright notice and this permission notice shall be included in\n# all copies. The software is provided \"as is\", without warranty",
        "Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. Neither the name of X may be used to endorse or promote it.",
        "Licensed under CC BY-NC 4.0.",
        "It is available under the Foo terms.",
        "it has no words of that kind",
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(6)] == ["MIT", "MIT", "BSD-3-Clause", "CC-BY-NC-4.0", "", ""]
    assert got[4].status in ("unknown", "none") and got[5].status == "none"
    assert license_scan.license_scan(docs).count() == docs.count() and license_scan.license_scan(empty).count() == 0


def scan(spark, texts):
    return {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_op3_long_runs_and_texts_without_breaks(spark):
    mit = "Licensed under the MIT License. "
    runs = ["=", "!", ";", ".", ":", " ", "\t", "\r", "\n", "\f", "-", "*", "#", "/", ",", "A", "a", "0", "1.", "A ", "; ", "! ", "MIT ", "v. ", "(", "\n# ", "the\n", "許", "ไทย", "عقد ", "é", "unknown license terms. "]
    texts = [mit + x * (100_000 // len(x)) for x in runs] + [x * (100_000 // len(x)) + "\n" + mit for x in runs]
    texts += [mit + "本许可证的授权条款如下 license 以及其他" * 50_000, mit + "x" * 1_000_000, mit + "license " * 120_000]
    got = scan(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert "MIT" in got[i].licenses.split(",") or "MIT License" not in t, (i, t[:40], got[i])


APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""


def test_op3_whole_notices(spark):
    cases = [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT", "known"),
        ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause", "BSD-3-Clause,GPL-2.0", "known"),
        ("SPDX-License-Identifier: Zlib", "Zlib", "known"),
        ("SPDX-License-Identifier: CC-BY-4.0", "CC-BY-4.0", "known"),
        ("This code is not licensed under the MIT License.", "", "none"),
        ("All profits are distributed under the old scheme.", "", "none"),
        (APACHE, "Apache-2.0", "known"),
        ("This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "GPL-2.0", "known"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nThis License applies to any program distributed under the terms of this General Public License agreement.\nYou may copy it under the terms of the GNU General Public License.\nThe licenses of most software are license terms.", "GPL-2.0", "known"),
        ("Mozilla Public License Version 1.1\n\nThe code is licensed under other license terms.", "MPL-1.1", "known"),
        ("GNU Free Documentation License\nVersion 1.3, 3 November 2008\n", "GFDL", "known"),
        ("It is licensed under the Foo License.\nGNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0", "partial"),
    ]
    got = scan(spark, [t for t, _, _ in cases])
    for i, (text, licences, status) in enumerate(cases):
        assert (got[i].licenses, got[i].status) == (licences, status), (text, got[i])


def test_op3_every_sentence_in_its_common_form(spark):
    forms = [
        ("spdx-mit", "// SPDX-License-Identifier: MIT"),
        ("spdx-apache2", "# SPDX-License-Identifier: Apache-2.0\n# Copyright 2020 X"),
        ("spdx-gpl3", "/* SPDX-License-Identifier: GPL-3.0-or-later */"),
        ("spdx-gpl2", "SPDX-License-Identifier: GPL-2.0-only"),
        ("spdx-bsd3", "<!-- SPDX-License-Identifier: BSD-3-Clause -->"),
        ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"),
        ("mit-notice", "The above copyright notice and this permission notice shall be included in all\ncopies"),
        ("as-is", '// THE SOFTWARE IS\n// PROVIDED "AS IS", WITHOUT\n// WARRANTY OF ANY KIND'),
        ("bsd-source", "1. Redistributions of source code must retain the above copyright\n   notice, this list"),
        ("bsd-binary", "2. Redistributions in binary form must reproduce the above copyright notice"),
        ("bsd-name", "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products"),
        ("apache2-ref", '# Licensed under the\n# Apache License, Version 2.0 (the "License");'),
        ("apache2-link", "     http://www.apache.org/licenses/LICENSE-2.0"),
        ("agpl3-ref", "under the terms of the GNU Affero General Public License, version 3"),
        ("lgpl-ref", "under the terms of the GNU Lesser General Public License"),
        ("gpl3-ref", "licensed under the GNU General Public License, version 3."),
        ("gpl2-ref", " * under the terms of the GNU General Public License\n * Version 2"),
        ("gpl-any-ref", "redistribute it under the terms of the GNU General Public License as published"),
        ("mit-ref", "Released under the MIT\nLicense."),
        ("bsd3-ref", "Distributed under the BSD 3-Clause."),
        ("mpl2-ref", "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0."),
        ("cc-by-nc-4", "Licensed under CC BY-NC 4.0."),
        ("cc-by-sa-4", "licensed under a CC BY-SA 4.0 license"),
        ("cc-by-4", "This work is licensed under CC BY 4.0"),
        ("cc0", "It is dedicated to the public domain"),
        ("", "My driving license is new."),
        ("unknown", "It is available under the Foo terms."),
        ("unknown", "SPDX-License-Identifier: WTFPL"),
        ("spdx-isc", "SPDX-License-Identifier: ISC"),
        ("spdx-agpl3", "SPDX-License-Identifier: AGPL-3.0-only"),
        ("spdx-lgpl", "// SPDX-License-Identifier: LGPL-2.1-or-later"),
        ("spdx-mpl2", "SPDX-License-Identifier: MPL-2.0"),
        ("spdx-bsd2", "SPDX-License-Identifier: BSD-2-Clause"),
        ("spdx-epl2", "SPDX-License-Identifier: EPL-2.0"),
        ("spdx-unlicense", "SPDX-License-Identifier: Unlicense"),
        ("spdx-cc0", "SPDX-License-Identifier: CC0-1.0"),
        ("apache2-title", "                                 Apache License\n                           Version 2.0, January 2004"),
        ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007"),
        ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
        ("lgpl21-title", "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999"),
        ("gpl3-title", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
        ("gpl2-title", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991"),
        ("mpl2-title", "Mozilla Public License Version 2.0"),
        ("epl2-ref", "made available under the terms of the\nEclipse Public License 2.0"),
        ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above"),
        ("unlicense-grant", "This is free and unencumbered software released into the public domain."),
        ("boost-ref", "Distributed under the Boost Software License, Version 1.0."),
        ("zlib-as-is", "This software is provided 'as-is', without any express or implied\nwarranty."),
        ("zlib-origin", "1. The origin of this software must not be misrepresented"),
        ("bsd2-ref", "Released under the 2-clause BSD license"),
        ("gpl3-ref", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"),
        ("gpl2-ref", "GNU General Public License as published by the Free Software Foundation, version 2"),
        ("agpl3-ref", "the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the"),
        # none of these is a licence sentence
        ("spdx-zlib", "SPDX-License-Identifier: Zlib"),
        ("spdx-boost", "SPDX-License-Identifier: BSL-1.0"),
        ("spdx-cc-by-4", "SPDX-License-Identifier: CC-BY-4.0"),
        ("spdx-cc-by-sa-4", "SPDX-License-Identifier: CC-BY-SA-4.0"),
        ("spdx-artistic2", "SPDX-License-Identifier: Artistic-2.0"),
        ("gpl1-title", "GNU GENERAL PUBLIC LICENSE\n  Version 1, February 1989"),
        ("lgpl2-title", "GNU LIBRARY GENERAL PUBLIC LICENSE\n  Version 2, June 1991"),
        ("mpl11-title", "Mozilla Public License Version 1.1"),
        ("gfdl-title", "GNU Free Documentation License\n  Version 1.3, 3 November 2008"),
        ("artistic-title", 'The "Artistic License"'),
        ("cc0-title", "CC0 1.0 Universal"),
        ("body", "Unless required by law, software distributed under the License comes without any promise"),
        ("", "Eclipse season begins with a public lecture, version 2.0 of the programme."),
        ("", "We released the birds into the public park."),
        ("", "The origin of this river is unknown to the public."),
        # lines that stand for themselves stay apart
        ("spdx-mit,spdx-apache2", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0"),
        ("mit-ref,cc-by-4", "Released under the MIT License,\nLicensed under CC BY 4.0"),
        ("mit-ref,mit-grant", "Released under the MIT License: Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ]
    assert {n for n, _ in license_scan.PATTERNS} <= {i for n, _ in forms for i in n.split(",")} | {"unlike"}
    got = license_scan.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(forms)], "doc_id long, text string")).collect()
    assert [r.sentence_ids for r in sorted(got)] == [n for n, _ in forms]
    ruled = {i for run, _ in (*license_scan.RULES, *license_scan.MORE_RULES) for i in run}
    assert {n for n, _ in license_scan.PATTERNS} - ruled <= {"unlike", "unknown", "body"}
    zlib = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n1. The origin of this software must not be misrepresented; you must not claim it."
    assert license_scan.license_scan(spark.createDataFrame([(1, zlib)], "doc_id long, text string")).first().licenses == "Zlib"


def test_op4_ids_are_the_librarys(docs, empty):
    enc = AgendaEncoder(tokenizer_path("piece_bpe_32k.model"))
    got = id_digests(encode_decode(docs.select("doc_id", "text", "lang"), tokenizer_path("piece_bpe_32k.model"))).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = enc.library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(enc.library.decode(ids).encode()).hexdigest()
    assert encode_decode(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_op4_agenda_on_odd_texts():
    import random

    enc = AgendaEncoder(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(2)
    pool = [*"ab \n\t▁.é漢\x00𝄞", "  ", "the", "<s>", "▁▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 50))) for _ in range(3000)]
    want = enc.library.encode(texts, num_threads=1)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode(texts)] == want


def test_op5_recall_ties_and_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[100:160] = x[99]  # equal vectors
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(2000, None, "x"), (2020, [0.0] * 16, "x"), (2040, [float("nan")] * 16, "x"), (2060, [None] * 16, "x"), (2080, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = np.round(x @ x[q], 9)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        hit += len({i for i, _ in found} & set(want.tolist()))
        assert len(found) == 20 and np.allclose([v for _, v in found], [x[i] @ x[q] for i, _ in found])
    assert hit >= 0.9 * 20 * len(got)
    few = nearest(df.where("vec_id < 5"), F.col("vec_id") == 0)
    assert [r.rank for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert nearest(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_op5_equal_scores_go_by_id(spark):
    x = np.zeros((20_000, 8))
    x[:, 0], x[:, 1:] = 1, np.random.default_rng(4).normal(size=(20_000, 7))
    x[0, 1:] = 0
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") == 0, reach=8.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}


def test_op5_repeated_ids_and_clusters(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 24))
    x = centers[rng.integers(0, 40, 6000)] + 0.2 * rng.normal(size=(6000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[20].tolist()), (20, x[20].tolist()), (20, x[99].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(40, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(got[q]) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(range(40, 6000, 20))
    assert all(len(v) == 20 and q not in v for q, v in got.items()) and set(got) == set(range(0, 6000, 20))


def test_op6_files_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    docs = docs.union(docs.where("doc_id = 4").withColumn("doc_id", F.expr("-9223372036854775807L - 1")))
    huffman_ids.write_id_files(docs, str(tmp_path / "a"), path, 2)
    got = huffman_ids.id_checksums(huffman_ids.read_id_files(spark, str(tmp_path / "a"))).orderBy("start").collect()
    lib, at = Tokenizer.from_file(path), 0
    want = defaultdict(list)
    for r in docs.collect():
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: -(2**64) if x is None else x)
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    huffman_ids.write_id_files(empty, str(tmp_path / "b"), path, 2)
    assert huffman_ids.read_id_files(spark, str(tmp_path / "b")).count() == 0


def test_op6_parts_give_the_librarys_ids():
    import random

    import pyarrow as pa

    from waymark.llm.hashing import text_chunks

    tok = huffman_ids.ChunkTokenizer(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(7)
    pool = ["the", "Word", "it's", "'ll", "'", '"', ".", ",", "(", "12", "9", " ", " ", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x00", "\x85", "\u00a0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\ufeff", "\u0300", "é", "漢字", "Ж", "𝄞", "²", "٣", "<|endoftext|>", "<|", "|>", "_", "..."]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(30_000)] + ["x" * 3000, "", " ", "\n"]
    want = [x.ids for x in tok.library.encode_batch_fast(texts, add_special_tokens=False)]
    for size in (1 << 10, 1 << 16):
        tok._forget()
        for first, data, offsets in text_chunks(pa.array(texts), size):
            flat, sizes = tok.encode(data, offsets)
            for k, (end, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True), first):
                assert flat[end - n : end].tolist() == want[k], texts[k]


@pytest.mark.parametrize("n", [1, 2, 3, 300, 40_000])
def test_op6_codes(n):
    counts = np.random.default_rng(n).zipf(1.2, n) % 10**8 + 1
    lengths = huffman_ids.code_lengths(counts)
    assert lengths.max() <= huffman_ids.MAX_BITS and (n == 1 or abs((0.5 ** lengths[lengths > 0]).sum() - 1) < 1e-9)
    ids = np.random.default_rng(1).choice(n, 5000, p=counts / counts.sum()).astype(np.uint32)
    offsets, bits = huffman_ids.pack(ids, lengths, huffman_ids.canonical_codes(lengths))
    back = huffman_ids.unpack(bits, offsets, len(ids), huffman_ids.decode_table(lengths, huffman_ids.MAX_BITS), huffman_ids.MAX_BITS)
    assert (back == ids).all()


def test_op7_examples(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a\\b <|x|> \\<|"), (1, 2, "assistant", "r1"), (1, 3, "user", None), (1, 4, "assistant", "</s>"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, None, None, None), (4, 0, "assistant", ""), (4, 0, "assistant", "")]
    df = chat_format.with_probe(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    records = chat_format.format_chats(df).orderBy("conv_id", "example").collect()
    one = [r for r in records if r.conv_id == 1]
    assert [r.n_turns for r in one] == [3, 5, 6] and one[-1].loss_start is None
    assert one[0].formatted[one[0].loss_start : one[0].loss_start + one[0].loss_chars] == "r1"
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(df)).collect()}
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns[:6])
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[1].n_turns == 6
    assert got[1].loss_sha256 == hashlib.sha256(b"r1</s>").hexdigest() and got[1].loss_chars == 6
    assert got[-7].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert got[4].n_turns == 2 and got[2].loss_chars == 0
    assert chat_format.chat_digests(chat_format.format_chats(df.limit(0))).count() == 0


def statistics(t):
    """Brute force of one text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = WORD.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 2 * len(cover) > len(w))


def line_key(x):
    return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def after_quality(rows):
    """Brute force over (id, text, source): (id, text) of what the quality rules keep."""
    held, texts = defaultdict(set), defaultdict(set)
    for _, t, host in rows:
        texts[host].add(t or "")
        for x in (t or "").split("\n"):
            held[host, line_key(x)].add(t or "")
    above = {k for k, v in held.items() if k[1] and len(v) >= 20 and len(v) > 0.05 * len(texts[k[0]])}
    out = []
    for i, t, host in rows:
        lines = (t or "").split("\n")
        keys = {line_key(x) for x in lines} - {""}
        left = sum(len(k) for k in keys if (host, k) not in above)
        if not statistics(t or "")[-1] and not left < 0.3 * sum(map(len, keys)):
            out.append((i, "\n".join(x for x in lines if (host, line_key(x)) not in above)))
    return out


def after_lines(rows):
    """Brute force over (id, text): (id, lines, dropped, text) after line dedup."""
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[line_key(x)].add(i)
    frequent = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if frequent.get(line_key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_op8_statistics(docs, empty):
    for r in quality_rules(docs).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect():
        assert tuple(r)[2:] == statistics(r.text or "")
    assert quality_rules(docs).count() == docs.count() and quality_rules(empty).count() == 0


def test_op8_op9_and_the_mix_keep_columns_of_any_name(spark):
    names = "gone_key _row _t _w _l _b _k _p own_id _lines host t own name above keyed lines did salt flips chars left nth again row size blocks pi".split()
    rows = [(i, "a line that many documents hold here\nand one more " * 20, ["s", None][(i or 0) % 2]) for i in [*range(30), None, None]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(f"my {n}").alias(n) for n in names])
    for out in (quality_rules(df), line_dedup(df), take_mix(df, mix_sources(df))):
        got = out.collect()
        assert got and all(r[n] == f"my {n}" for r in got for n in names)
    for out in (quality_rules(df), line_dedup(df)):
        assert out.count() == 32
    clash = df.withColumns({c: F.lit("x") for c in ("kept", "n_words", "n_lines", "kept_text")})
    assert {r.n_words for r in quality_rules(clash).collect()} == {200} and {r.n_lines for r in line_dedup(clash).collect()} == {21}
    assert license_scan.license_scan(clash.withColumn("ids", F.lit(1)).withColumn("rest", F.lit(1))).count() == 32
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", "y"), (1, 1, "assistant", "b", "x", "y")], "conv_id long, turn long, role string, text string, parts string, t string")
    assert [r.loss_chars for r in chat_format.format_chats(turns).collect()] == [1]


def test_op8_depleted(spark):
    line = "the same boilerplate line on all the pages of this host"
    own = lambda i: " ".join(f"t{i}x{k}" for k in range(60))
    rows = [(i, f"{line}\n{line} too\n{own(i)}", "h") for i in range(40)] + [(100 + i, "\n".join([line, line + " too"] + [f"{line}" for _ in range(1)]) + f"\nq{i}", "h") for i in range(3)]
    got = {r.doc_id: r.depleted for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(40)) and all(got[100 + i] for i in range(3))


def test_op8_frequent_lines_are_removed(spark):
    import corpus_pipeline

    line = "The same boilerplate line on all the pages of this host"
    own = lambda i: " ".join(f"t{i}x{k}" for k in range(60))
    texts = {i: f"{line}\n{own(i)}\n\n  {line.upper()} \nend {i}" for i in range(40)} | {50: own(50), 51: None}
    rows = [(i, t, h, "en", len(t or "")) for i, t in texts.items() for h in ("h", None)] + [(90, texts[0], "small host", "en", len(texts[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        lost = r.doc_id < 40
        assert r.n_removed_lines == (2 if lost else 0) and r.kept == (r.text is not None)
        assert r.kept_text == (f"{own(r.doc_id)}\n\nend {r.doc_id}" if lost else r.text)
    out = corpus_pipeline.quality(spark, docs, "").collect()
    assert len(out) == 83 and all((r.doc_id == 90) == (line in r.text) and r.n_chars == len(r.text) for r in out)


def test_op9_lines(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = {i: tuple(x) for i, *x in after_lines(rows)}
    got = line_dedup(docs).where("doc_id IS NOT NULL").collect()
    assert len(got) == len(rows) and all((r.n_lines, r.n_dropped, r.kept_text) == want[r.doc_id] for r in got)
    assert any(r.n_dropped for r in got) and line_dedup(empty).count() == 0


def test_op9_repeated_and_null_ids_with_other_texts(spark, monkeypatch):
    from waymark.llm import line_dedup as module

    shared = "a line that several of the documents hold"
    rows = [(None, f"alpha alpha alpha alpha alpha\n{shared}\nx"), (None, "beta beta beta beta beta beta\nPRECIOUS LINE THAT NOBODY ELSE HOLDS\ny")]
    rows += [(i, f"{shared}\n  {shared.upper()}") for i in (1, 2, 9)] + [(1, f"own\nONE MORE LINE THAT NOBODY HOLDS\n{shared}"), (9, f"again\n{shared}"), (2, None), (1, f"own\nONE MORE LINE THAT NOBODY HOLDS\n{shared}")]
    rows += [(None, f"{shared}\n{shared}\nlast"), (7, "only the line of one document\n" * 5), (7, "only the line of one document"), (7, "only the line of one document")]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-1 if i is None else i)
    stays = lambda i, line: len(key(line)) < 20 or len(held[key(line)]) < 3 or max(held[key(line)]) == (-1 if i is None else i)
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if stays(i, x))) for i, t in rows)
    for most in (512, 2):
        monkeypatch.setattr(module, "RUN_ROWS", most)
        got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.kept_text) for r in got) == want
        assert sum(r.n_dropped for r in got) == 9  # 1 and 2 of null ids, 2 of 1, 2 of 2, and 1 of both "own" rows


def test_op9_a_split_run_agrees(spark, monkeypatch):
    from waymark.llm import line_dedup as module

    monkeypatch.setattr(module, "RUN_ROWS", 3)
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a line that all documents hold\nx").alias("text"))
    got = {r.doc_id: r.kept_text for r in line_dedup(df).collect()}
    assert got[39].startswith("a line") and all(got[i] == "x" for i in range(39))


def test_op10_against_plain_python(spark):
    import math

    rng = np.random.default_rng(12)
    words = {"aa": ["kala", "mato", "Suna!"], "bb": ["chrst", "éàü", "zdrv"], "cc": ["ngomi", "kala", "ouiea"], "dd": ["x", "漢字", "mato"]}
    rows = [(i, " ".join(rng.choice(words[k], rng.integers(1, 9))), k) for i, k in enumerate(["aa", "bb", "cc", "dd"] * 40)]
    got = {r.doc_id: r for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def grams(text):
        b = [32, *(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in text.encode()), 32]
        out = []
        for x, y, z in zip(b, b[1:], b[2:]):
            h = (x * 0x9E3779B1 ^ y * 0x85EBCA6B ^ z * 0xC2B2AE35) & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 17)
        return out

    langs, code = sorted(words), codewords(4).tolist()
    bits = range(len(code[0]))
    learned = [(t, langs.index(k)) for i, t, k in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = [Counter(g for t, k in learned if k == lang for g in grams(t)) for lang in range(4)]
    share = lambda lang, g: (counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * (1 << 15))
    mean = lambda g, b, side: sum(share(k, g) for k in range(4) if code[k][b] == side) / sum(code[k][b] == side for k in range(4))
    weight = {g: [math.log(mean(g, b, 1) / mean(g, b, -1)) for b in bits] for _, t, _ in rows for g in grams(t)}
    margin = lambda t, b: sum(weight[g][b] for g in grams(t)) / len(grams(t))
    trust = [[(sum(margin(t, b) * code[k][b] > 0 for t, lang in learned if lang == k) + 1) / (sum(lang == k for _, lang in learned) + 2) for b in bits] for k in range(4)]
    trust = [[x / sum(row) for x in row] for row in trust]
    for i, t, _ in rows:
        loss = [sum(math.log1p(math.exp(-4 * margin(t, b) * code[k][b])) * trust[k][b] for b in bits) for k in range(4)]
        best = min(range(4), key=lambda k: loss[k])
        assert got[i].lang_pred == langs[best]
        assert abs(got[i].score - 1 / sum(math.exp(-(x - loss[best]) * len(bits)) for x in loss)) < 1e-3


def test_op10_languages(spark, docs, empty):
    rng = np.random.default_rng(3)
    words = {"aa": ["kala", "mato", "suna", "talo"], "bb": ["chrst", "wplk", "zdrv", "krk"], "cc": ["ngomi", "weeu", "ouiea", "yaai"]}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k, "s") for i, k in enumerate(["aa", "bb", "cc"] * 200)]
    rows += [(9000, None, "aa", "s"), (9001, "123 !", None, "s"), (9002, "kala mato", None, "s")]
    got = {r.doc_id: r for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()}
    held = [r for r in rows[:600] if got[r[0]].held_out]
    assert all(zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in held) and held
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert got[9000].lang_pred == got[9001].lang_pred == "und" and got[9002].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify_language(docs).count() == docs.count() and identify_language(empty).count() == 0
    for n in (2, 4, 9):
        c = codewords(n)
        assert len({tuple(x) for x in c}) == n


def test_op10_many_languages_and_rows_without_id(spark):
    rng = np.random.default_rng(21)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{k:03d}": ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(12)] for k in range(300)}
    rows = [(i if i % 5 else None, " ".join(rng.choice(words[f"l{i % 300:03d}"], 25)), f"l{i % 300:03d}") for i in range(3000)]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=4).collect()
    want = {t: k for _, t, k in rows}
    assert len(got) == 3000
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert sum(r.lang_pred == want[texts[r.doc_id]] for r in held) > 0.9 * len(held) > 0


@pytest.mark.parametrize("threshold", [0.5, 0.79, 1.01])
def test_op1_refuses_thresholds_that_signatures_cannot_serve(spark, threshold):
    with pytest.raises(ValueError, match="threshold"):
        ngram_jaccard_join(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), threshold)
