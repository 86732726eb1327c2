"""License scans by sentence rules, in built-in expressions only.

A text is cut into sentences, which are normalised and mapped to identifiers
of known licence sentences.  The identifiers in order are then matched against
ordered rules: each rule is a run of identifiers that means a licence, and the
rules before have the first pick, so that three BSD clauses aren't taken for
two.  Licence-like sentences that no pattern knows have an identifier too, and
what no rule picks is reported as left over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences: identifier -> pattern of a whole normalised sentence.  Fixed values; the first match counts.
SENTENCES = (
    ("spdx-mit", r".*spdx license identifier mit( .*)?"),
    ("spdx-apache2", r".*spdx license identifier apache 2\.0( .*)?"),
    ("spdx-gpl3", r".*spdx license identifier gpl 3\.0.*"),
    ("spdx-gpl2", r".*spdx license identifier gpl 2\.0.*"),
    ("spdx-bsd3", r".*spdx license identifier bsd 3 clause( .*)?"),
    ("mit-grant", r".*permission is hereby granted free of charge to any person obtaining a copy.*"),
    ("mit-notice", r".*the above copyright notice and this permission notice shall be included in.*"),
    ("as-is", r".*(software|work|material) is provided as is without warranty.*"),
    ("bsd-source", r".*redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r".*redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-name", r".*neither the name of .* may be used to endorse or promote.*"),
    ("apache2-ref", r".*(licensed|released|distributed|available) under the (terms of the )?apache license version 2\.0.*"),
    ("apache2-link", r".*www apache org licenses license 2\.0.*"),
    ("agpl3-ref", r".*under the (terms of the )?gnu affero general public license version 3.*"),
    ("lgpl-ref", r".*under the (terms of the )?gnu (lesser|library) general public license.*"),
    ("gpl3-ref", r".*under the (terms of the )?gnu general public license version 3.*"),
    ("gpl2-ref", r".*under the (terms of the )?gnu general public license version 2.*"),
    ("gpl-any-ref", r".*under the (terms of the )?gnu general public license.*"),
    ("mit-ref", r".*(licensed|released|distributed|available) under the (terms of the )?mit license.*"),
    ("bsd3-ref", r".*under (the |a )?(3 clause bsd|bsd 3 clause)( license)?.*"),
    ("mpl2-ref", r".*under the (terms of the )?mozilla public license (v |version )?2\.0.*"),
    ("cc-by-nc-4", r".*licensed under (a )?cc by nc 4\.0.*"),
    ("cc-by-sa-4", r".*licensed under (a )?cc by sa 4\.0.*"),
    ("cc-by-4", r".*licensed under (a )?cc by 4\.0.*"),
    ("cc0", r".*(cc0 1\.0|dedicated to the public domain).*"),
    ("unlike", r".*(unlicensed|license plate|driving license|poetic licen[sc]e).*"),
    ("unknown", r".*\b(licensed|released|distributed|available) under .*|.*\blicense(d)? (terms|agreement)\b.*"),
)
#: Ordered rules: the run of identifiers, the licence.  Fixed values.
RULES = (
    (("bsd-source", "bsd-binary", "bsd-name"), "BSD-3-Clause"),
    (("bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("mit-grant", "mit-notice", "as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("apache2-ref", "apache2-link"), "Apache-2.0"),
    (("apache2-ref",), "Apache-2.0"),
    (("spdx-apache2",), "Apache-2.0"),
    (("spdx-mit",), "MIT"),
    (("mit-ref",), "MIT"),
    (("spdx-bsd3",), "BSD-3-Clause"),
    (("bsd3-ref",), "BSD-3-Clause"),
    (("agpl3-ref",), "AGPL-3.0"),
    (("lgpl-ref",), "LGPL"),
    (("spdx-gpl3",), "GPL-3.0"),
    (("gpl3-ref",), "GPL-3.0"),
    (("spdx-gpl2",), "GPL-2.0"),
    (("gpl2-ref",), "GPL-2.0"),
    (("gpl-any-ref",), "GPL"),
    (("mpl2-ref",), "MPL-2.0"),
    (("cc-by-nc-4",), "CC-BY-NC-4.0"),
    (("cc-by-sa-4",), "CC-BY-SA-4.0"),
    (("cc-by-4",), "CC-BY-4.0"),
    (("cc0",), "CC0-1.0"),
)
#: Sentences that the SQL lacks: titles and bodies of further licences.  Fixed values.
MORE_SENTENCES = (
    ("spdx-agpl3", r".*spdx license identifier agpl 3\.0.*"),
    ("spdx-lgpl", r".*spdx license identifier lgpl .*"),
    ("spdx-mpl2", r".*spdx license identifier mpl 2\.0( .*)?"),
    ("spdx-bsd2", r".*spdx license identifier bsd 2 clause( .*)?"),
    ("spdx-isc", r".*spdx license identifier isc( .*)?"),
    ("spdx-epl2", r".*spdx license identifier epl 2\.0( .*)?"),
    ("spdx-unlicense", r".*spdx license identifier unlicense( .*)?"),
    ("spdx-cc0", r".*spdx license identifier cc0 1\.0( .*)?"),
    ("apache2-title", r".*apache license version 2\.0 january 2004.*"),
    ("agpl3-title", r".*gnu affero general public license version 3 19 november 2007.*"),
    ("lgpl3-title", r".*gnu lesser general public license version 3 29 june 2007.*"),
    ("lgpl21-title", r".*gnu lesser general public license version 2\.1 february 1999.*"),
    ("gpl3-title", r".*gnu general public license version 3 29 june 2007.*"),
    ("gpl2-title", r".*gnu general public license version 2 june 1991.*"),
    ("mpl2-title", r"mozilla public license (v |version )2\.0"),
    ("epl2-ref", r".*eclipse public license (v |version )?2\.0.*"),
    ("isc-grant", r".*permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted.*"),
    ("unlicense-grant", r".*this is free and unencumbered software released into the public domain.*"),
    ("boost-ref", r".*boost software license version 1\.0.*"),
    ("zlib-as-is", r".*this software is provided as is without any express or implied warranty.*"),
    ("zlib-origin", r".*the origin of this software must not be misrepresented.*"),
    ("bsd2-ref", r".*under (the |a )?((2 clause|simplified) bsd|bsd 2 clause)( license)?.*"),
    ("spdx-zlib", r".*spdx license identifier zlib( .*)?"),
    ("spdx-boost", r".*spdx license identifier bsl 1\.0( .*)?"),
    ("spdx-cc-by-4", r".*spdx license identifier cc by 4\.0( .*)?"),
    ("spdx-cc-by-sa-4", r".*spdx license identifier cc by sa 4\.0( .*)?"),
    ("spdx-artistic2", r".*spdx license identifier artistic 2\.0( .*)?"),
    ("gpl1-title", r".*gnu general public license version 1 february 1989.*"),
    ("lgpl2-title", r".*gnu library general public license version 2 june 1991.*"),
    ("mpl11-title", r".*mozilla public license version 1\.1( .*)?"),
    ("gfdl-title", r".*gnu free documentation license version 1\.[0-9].*"),
    ("artistic-title", r"(the )?artistic license( 2\.0)?"),
    ("cc0-title", r".*cc0 1\.0 universal.*"),
    ("unlike", r".*\b(not|never|cannot be|isn t|aren t) (be |being )?(licensed|released|distributed|available) under .*"),
    ("body", r".*\b(licensed|released|distributed|available) under (the|this) (same )?license\b.*"),
)
MORE_RULES = (
    (("zlib-as-is", "zlib-origin"), "Zlib"),
    (("isc-grant",), "ISC"),
    (("spdx-isc",), "ISC"),
    (("unlicense-grant",), "Unlicense"),
    (("spdx-unlicense",), "Unlicense"),
    (("epl2-ref",), "EPL-2.0"),
    (("spdx-epl2",), "EPL-2.0"),
    (("boost-ref",), "BSL-1.0"),
    (("apache2-title",), "Apache-2.0"),
    (("agpl3-title",), "AGPL-3.0"),
    (("spdx-agpl3",), "AGPL-3.0"),
    (("lgpl3-title",), "LGPL-3.0"),
    (("lgpl21-title",), "LGPL-2.1"),
    (("spdx-lgpl",), "LGPL"),
    (("gpl3-title",), "GPL-3.0"),
    (("gpl2-title",), "GPL-2.0"),
    (("mpl2-title",), "MPL-2.0"),
    (("spdx-mpl2",), "MPL-2.0"),
    (("spdx-bsd2",), "BSD-2-Clause"),
    (("bsd2-ref",), "BSD-2-Clause"),
    (("spdx-cc0",), "CC0-1.0"),
    (("spdx-zlib",), "Zlib"),
    (("spdx-boost",), "BSL-1.0"),
    (("spdx-cc-by-4",), "CC-BY-4.0"),
    (("spdx-cc-by-sa-4",), "CC-BY-SA-4.0"),
    (("spdx-artistic2",), "Artistic-2.0"),
    (("gpl1-title",), "GPL-1.0"),
    (("lgpl2-title",), "LGPL-2.0"),
    (("mpl11-title",), "MPL-1.1"),
    (("gfdl-title",), "GFDL"),
    (("artistic-title",), "Artistic"),
    (("cc0-title",), "CC0-1.0"),
)
#: Sentences that stand in the bodies of licences have one character each.  Those of a licence whose title came before
#: belong to it; "body" never says which licence, so rules look past it.
CODES = {"body": "^", "unknown": "~", "gpl-any-ref": "%", "lgpl-ref": "&", "as-is": "@", "cc0": "=", "mit-notice": "+", "unlicense-grant": "<"}
#: Further forms of known sentences, which the SQL lacks too.
FORMS = {
    "agpl3-ref": r"|.*gnu affero general public license as published by the free software foundation (either )?version 3.*",
    "gpl3-ref": r"|.*gnu general public license as published by the free software foundation (either )?version 3.*",
    "gpl2-ref": r"|.*gnu general public license as published by the free software foundation (either )?version 2.*",
    "mpl2-ref": r"|.*subject to the terms of the mozilla public license (v |version )?2\.0.*",
    "unknown": r"|.*spdx license identifier .*",
}
#: In place of the SQL's last pattern: what is only "distributed under" something has to speak of terms.
UNKNOWN = r".*\blicensed under .*|.*\b(released|distributed|available) under .*\b(licen[sc]e|licensing|terms|conditions|agreement|gpl|lgpl|bsd|copyleft)\b.*|.*\blicensed? (terms|agreement)\b.*"
PATTERNS = tuple((name, (UNKNOWN if name == "unknown" else pattern) + FORMS.get(name, "")) for name, pattern in (*MORE_SENTENCES, *SENTENCES))
#: Every pattern needs one of these, also before a sentence is normalised; texts without any are done at once.
CUE = r"(?i)licen|permission|redistributions|neither|warranty|cc0|dedicated|unencumbered|misrepresented|bsd|(?:released|distributed|available)[^a-z0-9]+under"
#: Java's matcher recurses for each repetition of a group that holds alternatives or repetitions, and a long run of blanks
#: must be entered once only: so nothing here repeats but single characters, and a break starts behind no blank.
_BREAK = r"[ \t\r]*+\n[ \t*#/-]*"
_GOES_ON = r"(?!SPDX|Licensed|Released|Distributed|Available)(?=[A-Za-z0-9(\"'])"
#: A line goes on the sentence of the line before, behind any comment marks, if it starts in lower case, if that
#: line stops at a comma or a word that ends no sentence, if both are in capitals, or inside a licence's name.
WRAP = r"(?=[ \t\r\n])(?<![ \t\r])(?=[ \t\r]*+\n)(?:" + "|".join(
    (
        _BREAK + r"(?=[a-z(])",
        r"(?<=,|\b(?i:the|a|an|of|or|and|to|in|by|under|with|without|for|that|this|be|is|as|any|must|shall|may|provided|version|v\.|identifier:))" + _BREAK + _GOES_ON,
        r"(?<=\b[A-Z]{2,20}[,\"']{0,2})" + _BREAK + _GOES_ON + r"(?=[(\"']?[A-Z]{2})",
        r"(?<=\b(?i:apache|mit|public|bsd|clause))" + _BREAK + r"(?=Licen[sc]e\b|3-Clause\b)",
        _BREAK + r"(?=Public License|General Public|Lesser General|Library General|Affero General|Version [0-9])",
    )
) + ")"
#: Neither the colon of an SPDX header nor the dot of "v. 2.0" ends a sentence, nor the semicolon of "; either version 2".
STOP = r"(?:[!?]|;(?![ \t]+either version)|\.(?!(?<=\b[vV]\.)[ \t]+[0-9])|(?<!(?i:license.identifier)):)[ \t\r\f]+|\n"
#: Dots stay inside version numbers only.
DOTS = r"(?<![0-9])\.|\.(?![0-9])"
#: One header may name several licences; exceptions go with the licence before.
SPDX = "spdx license identifier "
SPDX_NEXT = r" (?:or|and) (?=(?:mit|apache|gpl|lgpl|agpl|mpl|bsd|isc|epl|unlicense|cc0|cc|zlib|bsl|artistic|gfdl|wtfpl)\b)"
SPDX_WITH = r" with [a-z0-9. ]{1,40}exception( [0-9.]{1,5})?"


def _normal(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9.]+", " "), DOTS, " ")
    return F.btrim(F.regexp_replace(x, " {2,}", " "), F.lit(" ."))


def _sentences(text: Column) -> Column:
    cut = F.split(F.regexp_replace(text, WRAP, " "), STOP)
    likely = F.transform(F.filter(cut, lambda x: x.rlike(CUE)), _normal)
    header = lambda x: F.transform(F.split(F.regexp_replace(x, SPDX_WITH, ""), SPDX_NEXT), lambda y, i: F.when(i == 0, y).otherwise(F.concat(F.lit(SPDX), y)))
    return F.flatten(F.transform(likely, lambda x: F.when(F.contains(x, F.lit(SPDX)), header(x)).otherwise(F.array(x))))


def _identify(sentence: Column) -> Column:
    out = None
    for name, pattern in PATTERNS:
        at = sentence.rlike(f"^({pattern})$")
        out = F.when(at, name) if out is None else out.when(at, name)
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses, left_over, status), one row per row of ``docs``.

    ``sentence_ids`` are the identifiers in order, ``licenses`` what the rules
    found, in the order of the rules and each once, ``left_over`` the number of identifiers that
    no rule picked; lists are joined by commas.  ``status`` is "none" without
    licence sentences, "known" if rules picked all of them, else "partial" or
    "unknown".  Sentences of the identifier "unlike" only look like licences and
    are left out.  Null and empty texts have none; repeated rows give equal
    rows; an empty table gives no rows; other columns are ignored.  Whole texts
    are scanned, wherever the sentences stand.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.when(text.rlike(CUE), _sentences(text)).otherwise(F.array().cast("array<string>")).alias("s"))
    ids = F.filter(F.transform("s", _identify), lambda x: x.isNotNull() & (x != "unlike"))
    found = found.select("doc_id", ids.alias("ids")).withColumn("rest", _rest(F.col("ids")))
    return found.select("doc_id", "ids", *_match()).select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "left_over",
        F.when(F.size("ids") == 0, "none").when(F.col("left_over") == 0, "known").when(F.size("licenses") > 0, "partial").otherwise("unknown").alias("status"),
    )


def _mark(name: str) -> str:
    return CODES.get(name, f",{name},")


def _rest(ids: Column) -> Column:
    """The identifiers as a string, without those that belong to the body of a licence whose title stands before them."""
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    coded = F.array_join(F.transform(ids, lambda x: F.coalesce(F.try_element_at(codes, x), F.concat(F.lit(","), x, F.lit(",")))), "")
    return F.translate(F.regexp_replace(coded, f"(?<=-title,)[{''.join(map(re.escape, CODES.values()))}]+", ""), "^", "")


def _match() -> list[Column]:
    """Each rule takes its runs out of the string of identifiers; what stays goes to the next."""
    rest, picked = F.col("rest"), []
    for run, name in (*RULES, *MORE_RULES):
        mark = "".join(map(_mark, run))
        picked.append(F.when(F.instr(rest, mark) > 0, F.lit(name)))
        rest = F.replace(rest, F.lit(mark), F.lit(";"))
    # each identifier that stays is a code or a name between commas
    left = F.char_length(F.regexp_replace(F.regexp_replace(rest, ",[^,;]+,", "~"), ";+", ""))
    return [F.array_distinct(F.array_compact(F.array(*picked))).alias("licenses"), left.cast("long").alias("left_over")]


#: The SQL's own cuts: DuckDB's expressions can't look around, so it knows no SPDX headers, links or upper-case wraps.
_SQL_CUE = r"(?i)licen|permission|redistributions|neither the name|as is|cc0|dedicated to the public"
_SQL_WRAP = r"\n[ \t*#/-]*([a-z(])"
_SQL_STOP = r"[.;:!?]+[ \t\r\f]+|\n"
_SQL_NOISE = r"[^a-z0-9.]+"


def _sql() -> str:
    case = "CASE " + " ".join(f"WHEN regexp_full_match(x, '{p}') THEN '{n}'" for n, p in SENTENCES) + " END"
    rest, picked = "rest", []
    for run, name in RULES:
        mark = "," + ",,".join(run) + ","
        picked.append((f"strpos({rest}, '{mark}') > 0", name))
        rest = f"replace({rest}, '{mark}', ';')"
    steps, prev = [], "r0"
    for k, (run, name) in enumerate(RULES, 1):
        mark = "," + ",,".join(run) + ","
        steps.append(f"{prev}_ AS (SELECT *, strpos(rest, '{mark}') > 0 AS p{k} FROM {prev}), r{k} AS (SELECT * REPLACE (replace(rest, '{mark}', ';') AS rest) FROM {prev}_)")
        prev = f"r{k}"
    names = ", ".join(f"CASE WHEN p{k} THEN '{name}' END" for k, (_, name) in enumerate(RULES, 1))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(t, '{_SQL_WRAP}', ' \\1', 'g'), '{_SQL_STOP}'), lambda x: regexp_matches(x, '{_SQL_CUE}')) AS s FROM d),
n AS (SELECT doc_id, list_transform(s, lambda x: trim(regexp_replace(lower(x), '{_SQL_NOISE}', ' ', 'g'), ' .')) AS s FROM s),
i AS (SELECT doc_id, list_filter(list_transform(s, lambda x: {case}), lambda x: x IS NOT NULL AND x <> 'unlike') AS ids FROM n),
r0 AS (SELECT doc_id, ids, ',' || array_to_string(list_transform(ids, lambda x: x || ','), ',') AS rest FROM i),
{", ".join(steps)},
f AS (SELECT doc_id, ids, list_filter([{names}], lambda x: x IS NOT NULL) AS l, len(list_filter(string_split_regex(rest, '[,;]+'), lambda x: x <> ''))::BIGINT AS left_over FROM {prev})
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k), ','), '') AS licenses, left_over,
       CASE WHEN len(ids) = 0 THEN 'none' WHEN left_over = 0 THEN 'known' WHEN len(l) > 0 THEN 'partial' ELSE 'unknown' END AS status FROM f"""


SQL = _sql()
