"""Line dedup across documents: range-partitioned hashes, first occurrences, keep bitmaps.

Lines are hashed where they are read; only hashes that occur often enough to
matter go on.  Their occurrences are range-partitioned by hash and sorted by
document and position, so the first occurrence of a run is the document that
keeps the line.  The hashes of very common lines are split by document into
runs of their own; what the runs found is put together by a small sum.  The
result is, per document, where its keep bitmap flips: no text is moved until
a caller applies the bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import line_key
from .shared import NO_ID, discard, materialize, shuffle_partitions

#: Occurrences of a hash in one run.
RUN_ROWS = 512


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_key(docs: DataFrame) -> list[Column]:
    """(did, text_hash): rows that share an id have lines of their own unless their texts are equal."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")]


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(did, text_hash, flips) for rows that lose lines.

    ``flips`` are the line numbers at which the keep bitmap changes, starting
    from "keep": [2, 5] drops lines 2, 3 and 4.  A document is an id, whatever
    its rows; a bitmap belongs to a text.  Line keys are compared by 96 bits of
    two hashes, ``h`` and ``g``.
    """
    spark = docs.sparkSession
    key = ["h", "g"]
    rows = docs.select(*_row_key(docs), F.transform(split_lines(F.col("text")), line_key).alias("keys"))
    long_enough = F.transform("keys", lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g"), i.alias("pos"))))
    seen = rows.select("did", "text_hash", F.explode(F.array_compact(long_enough)).alias("x")).select("did", "text_hash", "x.*")
    often = materialize(seen.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs))
    held = materialize(seen.join(often, key))
    runs = F.ceil(F.col("n") / RUN_ROWS)
    held = held.withColumn("sub", F.when(runs > 1, F.pmod(F.xxhash64("did"), runs)).otherwise(F.lit(0)))
    ranged = held.repartitionByRange(shuffle_partitions(spark), *key, "sub")
    stream = Window.partitionBy(*key, "sub").orderBy(F.desc("did"), "pos")
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs_found = ranged.withColumn("first", F.first("did").over(stream)).withColumn("nth", F.dense_rank().over(Window.partitionBy(*key, "sub").orderBy(F.desc("did"))))
    runs_found = materialize(runs_found.withColumn("docs", F.last("nth").over(whole)).select(*key, "did", "text_hash", "pos", "n", "sub", "first", "docs"))
    split = runs_found.where(F.col("n") > RUN_ROWS).select(*key, "sub", "first", "docs").groupBy(*key, "sub").agg(F.max("first").alias("first"), F.max("docs").alias("docs"))
    split = materialize(split.groupBy(key).agg(F.max("first").alias("keeper"), F.sum("docs").alias("all_docs")))
    all_found = runs_found.join(split, key, "left").withColumn("keeper", F.coalesce("keeper", "first")).withColumn("all_docs", F.coalesce("all_docs", "docs"))
    drop = all_found.where((F.col("all_docs") >= min_docs) & (F.col("did") != F.col("keeper")))
    drop = drop.groupBy("did", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: F.coalesce(F.get("p", i - 1) != x - 1, F.lit(True)))
    ends = F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1) != x + 1, F.lit(True)))
    flips = F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))
    out = materialize(drop.select("did", "text_hash", flips.alias("flips")))
    discard(often, held, runs_found, split)
    return out


def kept_text(lines: Column, flips: Column) -> Column:
    """The lines that a bitmap keeps, joined again."""
    edges = F.concat(F.array(F.lit(0)), flips, F.array(F.size(lines)))
    parts = F.transform(F.sequence(F.lit(0), (F.size(edges) / 2 - 1).cast("int")), lambda k: F.slice(lines, F.get(edges, 2 * k) + 1, F.get(edges, 2 * k + 1) - F.get(edges, 2 * k)))
    return F.when(flips.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.flatten(parts), "\n"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep_flips (null: all kept) and kept_text.

    A line's key is the line stripped of white space with A-Z lower-cased.
    Keys of at least ``min_chars`` characters that at least ``min_docs``
    documents hold lose all their lines but in the largest doc_id that holds
    them; there repeated lines stay.  Rows with one doc_id are one document,
    rows with a null id one below all others: a line they share counts once,
    and each row loses lines by its own text.
    Null text is one empty line.  An empty table gives no rows; other columns
    stay, whatever their names, but for those with the names of the results.
    """
    made = ("n_lines", "n_dropped", "keep_flips", "kept_text")
    maps = line_bitmaps(docs, min_chars, min_docs)
    own = F.struct(*[c for c in docs.columns if c not in made]).alias("own")
    rows = docs.select(own, *_row_key(docs))
    # texts are dealt by id and text at every size; bitmaps grow with the documents, so they are never sent to all executors
    met = rows.join(maps.hint("merge"), ["did", "text_hash"], "left").withColumn("lines", split_lines(F.col("own.text")))
    gone = F.aggregate(F.transform("flips", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, b: a + b)
    met = met.select(
        "own", F.size("lines").cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"), F.col("flips").alias("keep_flips"), kept_text(F.col("lines"), F.col("flips")).alias("kept_text")
    )
    return met.select("own.*", *made)


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
f AS (SELECT k, max(doc_id) AS keeper FROM x WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
y AS (SELECT x.*, f.keeper IS NOT NULL AND x.doc_id <> f.keeper AS gone FROM x LEFT JOIN f ON x.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM y GROUP BY doc_id"""
