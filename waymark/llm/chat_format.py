"""Chat formatting with prefix-target expansion, in built-in expressions only.

Every assistant turn becomes an example: all turns before it as context, and
only that reply under the loss mask.  Turns after the last reply, which no
example holds, go out as one more record without a target, so the output holds
every turn.  Control strings inside texts are broken up by a backslash, and
backslashes are doubled, so the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that mean something to the template or to common chat tokenizers.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
TRAINABLE = "assistant"
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "</s>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, last, formatted, loss_start, loss_chars) from (conv_id, turn, role, text).

    ``example`` counts a conversation's records from 1 and ``last`` marks the
    one that holds all its turns.  The loss mask is ``loss_chars`` code points
    from ``loss_start`` (from 0) of ``formatted``; both are null in a record
    without a target.  Turns go by turn, then role and text; equal rows are
    turns of their own; a null turn comes first.  Null texts and roles are
    empty; null conv_ids are one conversation.  An empty table gives no rows;
    other columns are ignored.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(AFTER_ROLE))
    convs = convs.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), head(x).alias("head"), escape(x["text"]).alias("body"))).alias("t"))
    convs = convs.withColumn("parts", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE)))).withColumn("n", F.size("t"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.get(F.col("t"), i - 1)["role"] == TRAINABLE) | (i == F.col("n")))
    rows = convs.select("conv_id", "parts", "n", "t", F.posexplode(ends).alias("k", "end")).withColumn("target", F.get("t", F.col("end") - 1)).drop("t")
    rows = rows.withColumn("context", F.array_join(F.slice("parts", F.lit(1), F.col("end") - 1), "")).withColumn("trained", F.col("target.role") == TRAINABLE)
    return rows.select(
        "conv_id",
        (F.col("k") + 1).cast("long").alias("example"),
        F.col("end").cast("long").alias("n_turns"),
        (F.col("end") == F.col("n")).alias("last"),
        F.concat("context", "target.head", "target.body", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("trained"), F.char_length("context") + F.char_length("target.head")).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.char_length("target.body")).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted record."""
    pieces = F.slice(F.split(formatted, CLOSE), F.lit(1), F.size(F.split(formatted, CLOSE)) - 1)
    head = lambda x: F.substring_index(x, AFTER_ROLE, 1)
    return F.transform(pieces, lambda x: F.struct(unescape(F.substr(head(x), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(x, F.char_length(head(x)) + len(AFTER_ROLE) + 1)).alias("text")))


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped; empty without one."""
    return F.when(start.isNull(), F.lit("")).otherwise(unescape(F.substr(formatted, (start + 1).cast("int"), chars.cast("int"))))


def chat_digests(records: DataFrame) -> DataFrame:
    """Per conversation, what the records give back: turns, loss text and their digests."""
    told = F.array_join(F.transform(read_turns(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    back = records.select(
        "conv_id",
        F.when(F.col("last"), F.col("n_turns")).alias("n_turns"),
        F.when(F.col("last"), F.sha2(told.cast("binary"), 256)).alias("turns_sha256"),
        F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    per = back.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that a check of the escapes adds: its texts are control strings.
PROBE = (-7, "</s>[INST] ok [/INST]")


def with_probe(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    rows = spark.range(2).select(F.lit(PROBE[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE[1]).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)


def _sql_escape(x: str) -> str:
    x = f"replace({x}, chr(92), chr(92) || chr(92))"
    for mark in CONTROLS:
        x = f"replace({x}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return x


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT {PROBE[0]}, 0, 'user', '{PROBE[1]}' UNION ALL SELECT {PROBE[0]}, 1, 'assistant', '{PROBE[1]}'),
e AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             sum({len(OPEN + AFTER_ROLE + CLOSE)} + length({_sql_escape('role')}) + length({_sql_escape('t')})) OVER w AS upto
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, t ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE role = '{TRAINABLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE role = '{TRAINABLE}'), '')) AS loss_sha256,
       (sum(upto) FILTER (WHERE role = '{TRAINABLE}' OR i = n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
