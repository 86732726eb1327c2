"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.line_dedup import line_dedup
from waymark.llm.mixing import mix_sources, take_mix
from waymark.llm.ngram_join import keep_one_per_component
from waymark.llm.piece_bpe import encode_decode, id_digests
from waymark.llm.quality_rules import quality_rules
from waymark.llm.shared import discard, materialize
from waymark.llm.tokenizer_files import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted by frequent lines, without those lines."""
    out = quality_rules(docs).where("kept")
    chars = F.when(F.col("n_removed_lines") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": F.col("kept_text"), "n_chars": chars}).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that larger ids hold too."""
    out = line_dedup(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": chars}).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_per_component(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return take_mix(docs, mix_sources(docs)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document of the mix, and of what they decode to."""
    return id_digests(encode_decode(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mixing), ("SentencePiece encoding and decoding", encoding)]
#: SQL can't express the mix or the encoding; tests compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        read, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
