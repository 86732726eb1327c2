"""Quality rules: text statistics, and the frequency of lines across documents of a host.

Everything is built-in expressions, aggregates and joins.  Lines are hashed
within a row, once, into a table without texts; the count of documents per
(host, line) has map-side sums, and only lines that reach the least count go
any further, so a line that all documents share costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, WS_CLASS, discard, materialize

#: The characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
_WS_CHARS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, WS_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased only; ``lower`` does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_WS_CHARS)))


def text_statistics(df: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of column t.

    n_repeat_words counts the words inside three-word windows that occur twice
    or more.  A window's key is its hash above its position in one integer:
    sorted, equal windows are neighbours, and the positions come back from the
    low bits.  That is n log n in the text, and the whole text is used.
    """
    kept = df.columns
    df = df.withColumns({"_w": split_words(F.col("t")), "_l": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("_b", F.length(F.bin("n_words")))
    window = lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(3)])
    keys = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 3), lambda i: F.call_function("shiftleft", window(i.cast("int")), F.col("_b")).bitwiseOR(i))
    df = df.withColumn("_k", F.when(F.col("n_words") >= 3, F.sort_array(keys)).otherwise(F.array().cast("array<bigint>")))
    high = lambda x: F.call_function("shiftrightunsigned", x, F.col("_b"))
    again = F.filter("_k", lambda x, i: F.coalesce(high(F.get("_k", i - 1)) == high(x), F.lit(False)) | F.coalesce(high(F.get("_k", i + 1)) == high(x), F.lit(False)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b")) - 1
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask))))
    cover = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_p", i + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    return df.select(
        *kept,
        "n_words",
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        cover.alias("n_repeat_words"),
    )


def _keyed_lines(text: Column) -> Column:
    """(h, n) of each line in order: hash of its key, null for blank lines, and its length."""
    keys = F.transform(F.split(text, "\n"), line_key)
    return F.transform(keys, lambda x: F.struct(F.when(x != "", F.xxhash64(x)).alias("h"), F.char_length(x).alias("n")))


def _distinct(keyed: Column) -> Column:
    return F.array_distinct(F.filter(keyed, lambda x: x["h"].isNotNull()))


def frequent_lines(lines: DataFrame, min_docs: int = 20, max_share: float = 0.05) -> DataFrame:
    """(name, above), written: for each host of ``lines`` that has lines above the limit, the hashes of those lines.

    ``lines`` are (host, copy, keyed): a hash of the text and the hashes of its
    lines.  A line (stripped, A-Z lower-cased, hashed) is above the limit of
    its host if more than ``max_share`` of the host's documents and at least
    ``min_docs`` hold it; documents with equal texts count once, so copies
    alone don't condemn a text.  A host has at most 1 / ``max_share`` times
    its mean number of distinct lines a text above the limit.
    """
    held = lines.select("host", "copy", F.explode(_distinct(F.col("keyed"))).alias("line")).select("host", "copy", "line.h")
    often = materialize(held.groupBy("host", "h").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_docs).select(F.col("host").alias("o_host"), F.col("h").alias("o_h")))
    hits = held.join(often, F.col("host").eqNullSafe(F.col("o_host")) & (F.col("h") == F.col("o_h")))
    total = lines.groupBy("host").agg(F.countDistinct("copy").alias("host_docs")).withColumnRenamed("host", "t_host")
    count = hits.groupBy("host", "h").agg(F.countDistinct("copy").alias("docs"))
    above = count.join(total, F.col("host").eqNullSafe(F.col("t_host"))).where((F.col("docs") >= min_docs) & (F.col("docs") > F.lit(max_share) * F.col("host_docs")))
    out = materialize(above.groupBy(F.col("host").alias("name")).agg(F.collect_set("h").alias("above")))
    discard(often)
    return out


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_share: float = 0.5, min_left: float = 0.3, **limits) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, depleted, kept, n_removed_lines and kept_text.

    A row fails the base rules with fewer than ``min_words`` words or if more
    than ``max_repeat_share`` of its words are in repeated windows.
    ``kept_text`` is the text without the lines of :func:`frequent_lines`; a
    row is depleted if less than ``min_left`` of the characters of its
    distinct lines stay.  Rows that do neither are kept.  Null text is empty
    and fails; null hosts are one host; repeated rows get equal verdicts; an
    empty table gives no rows.  Other columns stay, whatever their names, but
    for those with the names of the results, which are replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "depleted", "kept", "n_removed_lines", "kept_text")
    own = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*own).alias("own"), F.col(host).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = materialize(rows.select("host", F.xxhash64("t").alias("copy"), _keyed_lines(F.col("t")).alias("keyed")))
    above = frequent_lines(lines, **limits)
    out = text_statistics(rows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > F.lit(100 * max_repeat_share) * F.col("n_words"))
    out = out.withColumn("base_failed", failed).join(above, F.col("host").eqNullSafe(F.col("name")), "left")
    keyed = out.withColumn("keyed", F.when(F.col("above").isNotNull(), _keyed_lines(F.col("t"))))
    frequent = lambda h: F.coalesce(F.array_contains("above", h), F.lit(False))
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    keyed = keyed.withColumn("distinct", _distinct(F.col("keyed")))
    measured = F.struct(*made[:6], "keyed", chars(F.col("distinct")).alias("chars"), chars(F.filter("distinct", lambda x: ~frequent(x["h"]))).alias("left"))
    # one row of a generator: filters on what it gives stay above, and nothing is computed twice
    out = keyed.select("own", "t", "above", F.inline(F.array(measured)))
    out = out.withColumn("depleted", F.coalesce(F.col("left") < F.lit(min_left) * F.col("chars"), F.lit(False)))
    out = out.withColumn("stay", F.filter(F.split("t", "\n"), lambda x, i: ~frequent(F.get("keyed", i)["h"])))
    out = out.withColumn("n_removed_lines", F.coalesce(F.size("keyed") - F.size("stay"), F.lit(0)).cast("long"))
    out = out.withColumn("kept_text", F.when(F.col("n_removed_lines") > 0, F.array_join("stay", "\n")).otherwise(F.col("own.text")))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return out.select("own.*", *made)


def _sql() -> str:
    word = WORD
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
keys AS (SELECT DISTINCT doc_id, source, t, k FROM (SELECT doc_id, source, t, translate(trim(unnest(string_split(t, chr(10))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM d) WHERE k <> ''),
host AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY 1),
lim AS (SELECT k.source, k.k FROM keys k JOIN host h ON k.source IS NOT DISTINCT FROM h.source GROUP BY 1, 2, h.docs HAVING count(DISTINCT k.t) >= 20 AND count(DISTINCT k.t) > 0.05 * h.docs),
gone AS (SELECT k.doc_id FROM keys k LEFT JOIN lim l ON k.source IS NOT DISTINCT FROM l.source AND k.k = l.k GROUP BY 1 HAVING sum(CASE WHEN l.k IS NULL THEN length(k.k) ELSE 0 END) < 0.3 * sum(length(k.k))),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id)
SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND m.doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM m"""


SQL = _sql()
