"""The corpus pipeline: quality, near-duplicates, repeated passages, mixing, packing.

Every stage takes what its predecessor kept, with the columns of ``documents``; the last returns the
packed pieces.  Other columns are dropped, and an empty table passes every stage.  Null, empty and
repeated rows: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import common, mixing, near_dedup, packing, quality, substring_dedup
from quillmark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject (8); null and empty texts stay, of repeated rows all or none."""
    return quality.filter_documents(docs, common.table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (5), one row of repeated ones; texts without words and null ids all stay."""
    return near_dedup.drop_near_duplicates(docs, percent=80).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document (2); null and empty texts and null ids stay as they are."""
    clean = substring_dedup.rewrite_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole and fractional repetitions that bring each source to its target (9); each row by itself, those without words go."""
    mixed = mixing.repeat_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed texts in balanced sequences of 4096 tokens (1), every row of them."""
    pieces = packing.pack(docs, tokenizer_path(), end_id=2, capacity=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", filter_quality),
    ("near-dedup", drop_near_duplicates),
    ("substring-dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Word hashes, a trained model and a tokenizer decide: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table, so nothing runs twice."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
